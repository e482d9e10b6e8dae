"""Where facts come from: declared predicates with fingerprints, checked before they enter."""
