"""A body's clauses, from left to right, as one DataFrame of its solutions.

Atoms become inner joins on the variables they share with what stands before them,
negation a left-anti join, aggregates a grouped table joined back, ``if`` a filter and
``let`` a column.  Catalyst picks the join strategies, pushes literals and filters into the
scans and prunes the columns that no later clause reads.

Rows on which an expression fails leave the plan at that clause and are kept as separate
plans in ``faults``: any row there makes the result indeterminate.  They are written with the
result, by the same job (see ``materialize.Stored``).

Aggregates that follow each other over the same rows of a relation are one scan and one join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.errors import Arithmetic, ExprFault
from lakelog.functions.exprs import compile_expr, literal
from lakelog.plans.ir import BOOL, Agg, Atom, Expr, If, LatticeRead, Let, Lit, Match, Negated, Relation, Var, Wild, type_of, variables
from lakelog.plans.typing_ import can_fault, infer

Scan = Callable[[int, str], DataFrame]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


@dataclass
class State:
    """Solutions so far; None is the one empty solution."""

    df: DataFrame | None = None
    columns: dict[str, str] = field(default_factory=dict)  # variable: column
    types: dict[str, str | None] = field(default_factory=dict)
    support: list[tuple[str, str]] = field(default_factory=list)  # relation, column
    faults: list[tuple[ExprFault, DataFrame]] = field(default_factory=list)

    def env(self) -> dict[str, Column]:
        return {v: F.col(c) for v, c in self.columns.items()}


class Body:
    """Compiles bodies; in support mode each solution carries the rows it comes from."""

    def __init__(self, spark: SparkSession, relations: dict[str, Relation], scan: Scan, support: bool = False):
        self.spark, self.relations, self.scan, self.keep_support = spark, relations, scan, support
        self.n = 0

    def fresh(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}{self.n}"

    def compile(self, body, outputs: tuple[Expr, ...]) -> State:
        state = State()
        done = 0
        for k, c in enumerate(body):
            if k < done:
                continue
            if isinstance(c, Match):
                self.match(state, k, c.atom, self.live(body[k + 1 :], outputs))
            elif isinstance(c, Negated):
                self.negated(state, k, c.atom)
            elif isinstance(c, If):
                value, kind = self.value(state, c.expr)
                state.df = state.df.filter(value if kind == BOOL else F.lit(False))
            elif isinstance(c, Let):
                value, kind = self.value(state, c.expr)
                self.bind(state, c.name, value, kind)
            else:
                same = self.alike(state, body[k:])
                done = k + len(same)
                self.aggregate(state, k, same)
        self.seed(state)
        return state

    @staticmethod
    def live(rest, outputs: tuple[Expr, ...]) -> set[str]:
        """Variables that are read later."""
        out = {v for e in outputs for v in variables(e)}
        for c in rest:
            if isinstance(c, (Match, Negated, Agg)):
                out |= set(c.atom.names())
            if isinstance(c, (If, Let)):
                out |= set(variables(c.expr))
            if isinstance(c, Agg) and c.arg is not None:
                out |= set(variables(c.arg))
        return out

    def seed(self, state: State) -> None:
        if state.df is None:
            state.df = self.spark.range(1).select(F.lit(1).alias(self.fresh("one")))

    # -- expressions
    def value(self, state: State, e: Expr) -> tuple[Column, str | None]:
        """The value and type of an expression; rows that fail leave the state."""
        self.seed(state)
        try:
            kind = infer(e, state.types)
        except ExprFault as fault:
            state.faults.append((fault, state.df))
            state.df = state.df.filter(F.lit(False))
            return F.lit(None), None
        value, failed = compile_expr(e, state.env())
        if failed is not None:
            state.faults.append((Arithmetic(f"arithmetic in {e}"), state.df.filter(failed)))
            state.df = state.df.filter(~failed)
        return value, kind

    def bind(self, state: State, name: str, value: Column, kind: str | None) -> None:
        column = self.fresh("v")
        state.df = state.df.withColumn(column, value)
        state.columns[name], state.types[name] = column, kind

    # -- atoms
    def source(self, state: State, k: int, atom: Atom, negated: bool = False) -> tuple[DataFrame, dict[str, str], list[tuple[str, str]], dict[str, str]]:
        """The filtered rows of an atom with own column names; its new variables; pairs of
        (state's column, own column) that must be equal; the types of new variables."""
        relation = self.relations[atom.relation]
        rows = self.scan(k, atom.relation)
        own = [self.fresh("c") for _ in relation.types]
        rows = rows.select(*[F.col(c).alias(o) for c, o in zip(relation.columns, own)])
        conditions: list[Column] = []
        new: dict[str, str] = {}
        types: dict[str, str] = {}
        keys: list[tuple[str, str]] = []
        for a, column, kind in zip(atom.args, own, relation.types):
            if isinstance(a, Wild) or negated and isinstance(a, LatticeRead):
                continue
            if isinstance(a, Lit):
                conditions.append(F.col(column) == literal(a.value) if type_of(a.value) == kind else F.lit(False))
            elif a.name in state.columns:
                if state.types[a.name] != kind:
                    conditions.append(F.lit(False))
                else:
                    keys.append((state.columns[a.name], column))
            elif a.name in new:
                if not negated:
                    conditions.append(F.col(new[a.name]) == F.col(column) if types[a.name] == kind else F.lit(False))
            else:
                new[a.name], types[a.name] = column, kind
        return (rows.filter(_all(conditions)) if conditions else rows), new, keys, types

    def match(self, state: State, k: int, atom: Atom, live: set[str]) -> None:
        rows, new, keys, types = self.source(state, k, atom)
        semi = state.df is not None and not self.keep_support and not live & set(new)
        if self.keep_support:
            s = self.fresh("s")
            whole = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("value")) for c, t in zip(rows.columns, self.relations[atom.relation].types)])
            rows = rows.select("*", F.struct(F.lit(atom.relation).alias("relation"), whole.alias("values")).alias(s))
            state.support.append((atom.relation, s))
            rows = rows.select(*new.values(), *[b for _, b in keys if b not in new.values()], s)
        else:
            rows = rows.select(*dict.fromkeys([*[c for v, c in new.items() if v in live], *[b for _, b in keys]]))
        if state.df is None:
            if not rows.columns:
                # only whether there is a row counts
                rows = self.source(state, k, atom)[0].limit(1).select(F.lit(1).alias(self.fresh("one")))
            state.df = rows
        else:
            condition = _all([F.col(a) == F.col(b) for a, b in keys])
            if semi:
                right = rows if keys else self.source(state, k, atom)[0].limit(1).select(F.lit(1).alias(self.fresh("one")))
                state.df = state.df.join(right, condition, "left_semi")
            elif keys:
                state.df = state.df.join(rows, condition)
            else:
                state.df = state.df.crossJoin(rows)
        for v, c in new.items():
            if self.keep_support or v in live:
                state.columns[v] = c
            state.types[v] = types[v]

    def negated(self, state: State, k: int, atom: Atom) -> None:
        rows, _, keys, _ = self.source(state, k, atom, negated=True)
        self.seed(state)
        if keys:
            rows = rows.select(*dict.fromkeys(b for _, b in keys))
            state.df = state.df.join(rows, _all([F.col(a) == F.col(b) for a, b in keys]), "left_anti")
        else:
            state.df = state.df.join(rows.limit(1).select(F.lit(1).alias(self.fresh("one"))), F.lit(True), "left_anti")

    # -- aggregates
    def shape(self, state: State, atom: Atom) -> tuple:
        """What decides which rows of the relation an aggregate's atom takes."""
        first: dict[str, int] = {}
        out = []
        for i, a in enumerate(atom.args):
            if isinstance(a, Lit):
                out.append(("literal", type_of(a.value), a.value))
            elif isinstance(a, Wild):
                out.append(None)
            elif a.name in state.columns:
                out.append(("key", a.name))
            else:
                out.append(("as", first[a.name]) if a.name in first else None)
                first.setdefault(a.name, i)
        return (atom.relation, *out)

    def alike(self, state: State, rest) -> list[Agg]:
        """The aggregate at the head of ``rest``, with those behind it that read the same rows,
        can't fail and read nothing that one before them binds."""
        out = [rest[0]]
        shape = self.shape(state, rest[0].atom)
        bound = {rest[0].name}

        def plain(c: Agg) -> bool:
            names = set(c.atom.names())
            return c.arg is None or not (can_fault(c.arg) or any(v in state.columns or v not in names for v in variables(c.arg)))

        for c in rest[1:] if plain(rest[0]) else []:
            read = set(c.atom.names()) if isinstance(c, Agg) else set()
            if not isinstance(c, Agg) or bound & read or not plain(c) or self.shape(state, c.atom) != shape:
                break
            out.append(c)
            bound.add(c.name)
        return out

    def aggregate(self, state: State, k: int, same: list[Agg]) -> None:
        self.seed(state)
        rows, new, keys, types = self.source(state, k, same[0].atom)
        at = {a.name: i for i, a in enumerate(same[0].atom.args) if not isinstance(a, (Lit, Wild))}
        own = {i: new[v] for v, i in at.items() if v in new}
        pairs = list(dict.fromkeys((a, b) for a, b in keys))
        by = list(dict.fromkeys(b for _, b in pairs))
        made = []
        for n, c in enumerate(same):
            if n:  # its variables by their places
                plain = rows.columns
                own_types = self.relations[c.atom.relation].types
                places = {a.name: i for i, a in reversed(list(enumerate(c.atom.args))) if not isinstance(a, (Lit, Wild)) and a.name not in state.columns}
                new = {v: own.get(i, plain[i]) for v, i in places.items()}
                types = {v: own_types[i] for v, i in places.items()}
            used = variables(c.arg) if c.arg is not None else []
            outer = [v for v in used if v in state.columns]
            try:
                kind = infer(c.arg, {**state.types, **types}) if c.arg is not None else None
                env = state.env() | {v: F.col(x) for v, x in new.items()}
                value, failed = compile_expr(c.arg, env) if c.arg is not None else (F.lit(1), None)
                error: ExprFault = Arithmetic(f"arithmetic in {c.arg}")
            except ExprFault as fault:
                value, failed, kind, error = F.lit(1), F.lit(True), None, fault
            if kind == BOOL:
                value = value.cast("bigint")
            if outer or failed is not None:
                # the argument reads outer variables, or may fail: only rows that an outer solution reaches count
                left = list(dict.fromkeys([a for a, _ in pairs] + [state.columns[v] for v in outer]))
                probe = state.df.select(*left).distinct() if left else state.df.limit(1)
                joined = probe.join(rows, _all([F.col(a) == F.col(b) for a, b in pairs])) if pairs else probe.crossJoin(rows)
                if failed is not None:
                    state.faults.append((error, joined.filter(failed)))
                    joined = joined.filter(~failed)
                by, rows = left, joined
                pairs = [(x, x) for x in left]
            function = {"count": F.count(F.lit(1)), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[c.function]
            if c.arg is None and c.function != "count":
                function = F.max(F.lit(0) if c.function == "sum" else F.lit(None))
            made.append((c, self.fresh("v"), function.cast("bigint")))
        again = {x: self.fresh("k") for x in by}
        table = rows.groupBy(*[F.col(x).alias(again[x]) for x in by]).agg(*[f.alias(name) for _, name, f in made])
        whole = [c.function in ("count", "sum") for c, _, _ in made]
        if by:
            condition = _all([F.col(a) == F.col(again[b]) for a, b in pairs])
            state.df = state.df.join(table, condition, "left" if all(whole) else "inner")
        else:
            state.df = state.df.crossJoin(table)
        for (_, name, _), keep in zip(made, whole):
            if keep:
                state.df = state.df.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
            else:
                state.df = state.df.filter(F.col(name).isNotNull())
        state.df = state.df.drop(*again.values())
        for c, name, _ in made:
            state.columns[c.name], state.types[c.name] = name, "int"


__all__ = ["Body", "State", "Var"]
