"""Programs and queries as data: grammar, intermediate form, static checks, strata."""
