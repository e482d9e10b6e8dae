"""The engine: a program, its facts, and what follows from them.

    engine = Engine.from_source(spark, '''
        relation edge(int, int);
        relation path(int, int);
        path(x, y) <-- edge(x, y);
        path(x, z) <-- edge(x, y), path(y, z);
    ''')
    engine.add_dataframe("edge", spark.read.parquet(...))
    engine.run()
    engine.relation("path")                                   # a DataFrame
    engine.query("(x) <-- path(x, y), if y == 3").df

Relations are DataFrames with columns c0, c1, ..., without duplicates and nulls.  While all
facts were asserted one by one and are few, evaluation stays in Python (``local_rows``).

On Spark the first run evaluates everything; later ones start from what was asserted since
(``fixpoint.run``), so that plans don't grow with the number of runs.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.errors import Arity, ColumnType, ExprFault, LakelogError, SchemaError, UnknownRelation
from lakelog.functions.exprs import SPARK_TYPES, compile_expr, literal, wrapping
from lakelog.operators import fixpoint, local
from lakelog.operators.body import Body
from lakelog.operators.fixpoint import Kept
from lakelog.operators.materialize import Stored
from lakelog.plans.check import check_query, warnings
from lakelog.plans.ir import BOOL, INT, ConjunctiveQuery, Program, Relation, Value, type_of
from lakelog.plans.parser import parse_program, parse_query
from lakelog.plans.stratify import stratify
from lakelog.plans.typing_ import check_aggregates, check_program, infer
from lakelog.store import FactStore

DEFAULT_CAP = 10_000
MAX_ITERATIONS = 1_000_000
LOCAL_ROWS = 200_000
#: Caps up to this one end the evaluation early, in one task; beyond it all solutions are counted.
LIMIT_ROWS = 1_000_000

_WHY = "array<struct<relation:string,values:array<struct<type:string,value:string>>>>"

Support = tuple[tuple[str, tuple[Value, ...]], ...]


@dataclass(frozen=True)
class RelationSchema:
    name: str
    columns: tuple[str, ...]
    doc: str | None = None


@dataclass(frozen=True)
class Derivation:
    """One way to derive a tuple: the rule's index, and the tuples its positive atoms matched."""

    rule: int
    support: Support


class Explanation(list):
    """Derivations, sorted; ``truncated`` if the cap cut some off."""

    truncated = False


class QueryResult:
    """Distinct rows of a query (columns o0, o1, ...), each with its justifications, and
    whether the cap cut solutions off."""

    def __init__(self, spark: SparkSession, types: list[str], truncated: bool, frame: DataFrame | None = None, found: dict[tuple, list[Support]] | None = None):
        self._spark, self.types, self.truncated = spark, types, truncated
        self._frame, self._found = frame, found

    @property
    def columns(self) -> list[str]:
        return [f"o{i}" for i in range(len(self.types))]

    @property
    def provenance(self) -> DataFrame:
        """The rows with ``justifications``: arrays of (relation, values) per solution."""
        if self._frame is None:
            kinds = ", ".join(f"{c} {SPARK_TYPES[t].simpleString()}" for c, t in zip(self.columns, self.types))
            rows = [(*r, [[(n, [(type_of(v), _text(v)) for v in t]) for n, t in s] for s in all_]) for r, all_ in self._found.items()]
            self._frame = self._spark.createDataFrame(rows, f"{kinds}, justifications array<array<struct<relation:string,values:array<struct<type:string,value:string>>>>>")
        return self._frame

    @property
    def df(self) -> DataFrame:
        return self.provenance.select(*self.columns)

    def rows(self) -> list[tuple]:
        """The rows, sorted; at most as many as the cap."""
        if self._found is not None:
            return sorted(self._found)
        return sorted(tuple(r) for r in self.df.collect())

    def justifications(self) -> dict[tuple, list[Support]]:
        """Row to its justifications; at most as many as the cap."""
        if self._found is not None:
            return {r: sorted(s) for r, s in self._found.items()}
        return {tuple(r)[:-1]: sorted(_support(s) for s in r.justifications) for r in self.provenance.collect()}

    def __len__(self) -> int:
        return len(self._found) if self._found is not None else self.df.count()

    def is_empty(self) -> bool:
        return not self._found if self._found is not None else self.df.isEmpty()


class Consequences:
    """What a speculation added, by relation; candidate facts included, displaced lattice values not."""

    def __init__(self, spark: SparkSession, relations: dict[str, Relation], frames: dict[str, DataFrame] | None, found: dict[str, list[tuple]] | None):
        self._spark, self._relations, self._frames, self._found = spark, relations, frames, found

    def added(self, relation: str) -> DataFrame:
        """The added tuples; none for a relation that is unknown or hasn't changed."""
        if relation not in self._relations:
            return self._spark.createDataFrame([], "c0 long")
        schema = fixpoint.schema(self._relations[relation])
        if self._found is not None:
            return self._spark.createDataFrame(self._found.get(relation, []), schema)
        return self._frames.get(relation, self._spark.createDataFrame([], schema))

    def rows(self, relation: str) -> list[tuple]:
        if self._found is not None:
            return self._found.get(relation, [])
        return sorted(tuple(r) for r in self.added(relation).collect())

    def __iter__(self) -> Iterator[tuple[str, DataFrame]]:
        for name in sorted(self._relations):
            rows = self.added(name)
            if not rows.isEmpty():
                yield name, rows

    def is_empty(self) -> bool:
        if self._found is not None:
            return not any(self._found.values())
        return all(f.isEmpty() for f in self._frames.values())


def _text(v: Value) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def _support(s) -> Support:
    read = {INT: int, BOOL: lambda x: x == "true", "sym": str}
    return tuple((a.relation, tuple(read[v.type](v.value) for v in a["values"])) for a in s)


class Engine(FactStore):
    def __init__(self, spark: SparkSession, program: Program, local_rows: int = LOCAL_ROWS, max_iterations: int = MAX_ITERATIONS):
        check_program(program)
        self.spark, self.program = spark, program
        self.strata = stratify(program)
        self.local_rows, self.max_iterations = local_rows, max_iterations
        self._tables: dict[str, local.Table] | None = {n: local.Table(r) for n, r in program.relations.items()} if local_rows else None
        self._start()

    def _start(self) -> None:
        """No facts on Spark."""
        self._kept: dict[str, Kept] = {} if self._tables is not None else self._empty()
        self._new: dict[str, list[DataFrame]] = {}  # asserted since the last run
        self._buffer: dict[str, list[tuple]] = {}
        self._ran = False
        self._changed: dict[str, DataFrame] = {}
        self._seen: dict[str, str] = {}  # fingerprints of predicates that were ingested

    @classmethod
    def from_source(cls, spark: SparkSession, text: str, **how) -> Engine:
        """An engine for the program; raises if it doesn't parse, type or stratify."""
        return cls(spark, parse_program(text), **how)

    # -- state
    @property
    def relations(self) -> dict[str, Relation]:
        return self.program.relations

    @property
    def is_local(self) -> bool:
        return self._tables is not None

    def _frame(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, fixpoint.schema(self.relations[name]))

    def _empty(self) -> dict[str, Kept]:
        return {n: Kept(self.spark, r, self._frame(n, [])) for n, r in self.relations.items()}

    def _to_spark(self) -> None:
        """Leave the local path for good."""
        if self._tables is not None:
            tables, self._tables = self._tables, None
            self._kept = {n: Kept(self.spark, t.relation, self._frame(n, list(t.rows))) for n, t in tables.items()}

    def _flush(self) -> None:
        for name, rows in self._buffer.items():
            self._new.setdefault(name, []).append(self._frame(name, rows))
        self._buffer = {}

    def _read(self, name: str) -> DataFrame:
        """All tuples of a relation on Spark, with those asserted since the last run."""
        self._flush()
        rows = self._kept[name].read()
        for new in self._new.get(name, []):
            rows = rows.union(new)
        return fixpoint.unique(self.relations[name], rows) if name in self._new else rows

    # -- facts
    def _checked(self, relation: str, values: Iterable[Value]) -> tuple:
        r = self.relations.get(relation)
        if r is None:
            raise UnknownRelation(f"unknown relation {relation}")
        row = tuple(values)
        if len(row) != len(r.types):
            raise Arity(f"{relation} has {len(r.types)} columns, not {len(row)}")
        for i, (v, t) in enumerate(zip(row, r.types)):
            if v is None or type_of(v) != t:
                raise ColumnType(f"{relation}, column {i}: {v!r} isn't {t}")
            if t == INT and not -(2**63) <= v < 2**63:
                raise ColumnType(f"{relation}, column {i}: {v} doesn't fit 64 bits")
        return row

    def add_fact(self, relation: str, values: Iterable[Value]) -> None:
        """Assert one tuple, of any relation, derived ones too."""
        row = self._checked(relation, values)
        if self._tables is not None:
            self._tables[relation].add(row)
            if sum(len(t.rows) for t in self._tables.values()) > self.local_rows:
                self._to_spark()
        else:
            self._buffer.setdefault(relation, []).append(row)

    def add_facts(self, facts: Iterable[tuple[str, Iterable[Value]]]) -> None:
        """Assert many tuples; all are checked before the first is added."""
        rows = [(name, self._checked(name, values)) for name, values in facts]
        for name, row in rows:
            self.add_fact(name, row)

    def add_dataframe(self, relation: str, df: DataFrame, nulls: str = "reject", distinct: bool = True) -> None:
        """Assert the rows of a DataFrame, columns by position.  Integers are widened; other
        types must fit.  ``nulls``: reject (checks the data), drop, or trust (there are none).
        ``distinct=False`` promises rows that repeat neither each other nor known ones: then
        nothing is shuffled, and scans stay prunable."""
        r = self.relations.get(relation)
        if r is None:
            raise UnknownRelation(f"unknown relation {relation}")
        if len(df.columns) != len(r.types):
            raise Arity(f"{relation} has {len(r.types)} columns, not {len(df.columns)}")
        for i, (f, t) in enumerate(zip(df.schema.fields, r.types)):
            kind = f.dataType.simpleString()
            if kind not in {INT: ("bigint", "int", "smallint", "tinyint"), BOOL: ("boolean",), "sym": ("string",)}[t]:
                raise ColumnType(f"{relation}, column {i}: {kind} isn't {t}")
        df = df.toDF(*r.columns).select(*[F.col(c).cast(SPARK_TYPES[t]).alias(c) for c, t in zip(r.columns, r.types)])
        some = " OR ".join(f"{c} IS NULL" for c in r.columns)
        if nulls == "drop":
            df = df.filter(f"NOT ({some})")
        elif nulls == "reject" and not df.filter(some).isEmpty():
            raise ColumnType(f"{relation}: there are nulls")
        self._to_spark()
        if distinct or r.lattice or self._ran or relation in self._new or relation in self._buffer:
            self._flush()
            self._new.setdefault(relation, []).append(df)
        else:
            self._kept[relation] = Kept(self.spark, r, self._kept[relation].read().union(df))

    # -- evaluation
    def run(self) -> Engine:
        """All rules to their fixed point, from the current state; nothing is ever retracted."""
        if self._tables is not None:
            before = copy.deepcopy(self._tables)
            try:
                local.run(self.program, self.strata, self._tables, self.max_iterations, self.local_rows)
                return self
            except local.TooLarge:
                self._tables = before
                self._to_spark()
            except LakelogError:
                self._tables = before
                raise
        self._flush()
        if self._ran:
            kept = {n: k.settled() if n in self._derived else k for n, k in self._kept.items()}
            self._kept = kept
            new = {n: reduce(DataFrame.union, rows) for n, rows in self._new.items()}
            self._kept, self._changed = fixpoint.run(self.spark, self.relations, self.strata, kept, self.max_iterations, new)
        else:
            kept = {n: Kept(self.spark, self.relations[n], self._read(n)) for n in self.relations}
            self._kept, self._changed = fixpoint.run(self.spark, self.relations, self.strata, kept, self.max_iterations)
        self._new, self._ran = {}, True
        return self

    @property
    def _derived(self) -> set[str]:
        return {h.relation for r in self.program.rules for h in r.heads}

    def relation(self, name: str) -> DataFrame:
        """All tuples; none for an unknown relation."""
        if name not in self.relations:
            return self.spark.createDataFrame([], "c0 long")
        if self._tables is not None:
            return self._frame(name, list(self._tables[name].rows))
        return self._read(name)

    def rows(self, name: str) -> list[tuple]:
        """All tuples in the driver, sorted; for small relations."""
        if self._tables is not None:
            return sorted(self._tables[name].rows) if name in self._tables else []
        return sorted(tuple(r) for r in self.relation(name).collect())

    def speculate(self, facts: Iterable[tuple[str, Iterable[Value]]]) -> Consequences:
        """What the facts would add, at the fixed point; the engine itself stays as it is."""
        self._flush()
        if self._ran:  # stored once, so that no fork evaluates it again
            self._kept = {n: k.settled() if n in self._derived else k for n, k in self._kept.items()}
        fork = copy.copy(self)
        fork._tables, fork._kept, fork._buffer = copy.deepcopy(self._tables), dict(self._kept), {}
        fork._new = {k: list(v) for k, v in self._new.items()}
        fork.add_facts(facts)
        fork.run()
        if self._tables is not None and fork._tables is not None:
            found = {n: sorted(r for r in t.rows if r not in self._tables[n].rows) for n, t in fork._tables.items()}
            return Consequences(self.spark, self.relations, None, {n: r for n, r in found.items() if r})
        if self._ran and not self._new:
            return Consequences(self.spark, self.relations, fork._changed, None)
        frames = {n: fork.relation(n).join(self.relation(n), r.columns, "left_anti") for n, r in self.relations.items()}
        return Consequences(self.spark, self.relations, frames, None)

    # -- queries
    def schema(self) -> list[RelationSchema]:
        return [RelationSchema(r.name, r.types, r.doc) for r in sorted(self.relations.values(), key=lambda r: r.name)]

    def parse_query(self, text: str) -> ConjunctiveQuery:
        return parse_query(text)

    def check(self, query: str | ConjunctiveQuery) -> list[str]:
        """Form, relations, arities and range restriction, without evaluation; gives warnings."""
        q = parse_query(query) if isinstance(query, str) else query
        check_query(q, self.relations)
        return warnings(q, self.relations)

    def query(self, query: str | ConjunctiveQuery, cap: int = DEFAULT_CAP) -> QueryResult:
        """A read-only query over the current state.  The cap counts solutions, not distinct rows."""
        q = parse_query(query) if isinstance(query, str) else query
        check_query(q, self.relations)
        return self.evaluate_query(q, cap)

    def evaluate_query(self, q: ConjunctiveQuery, cap: int = DEFAULT_CAP) -> QueryResult:
        """Without the check of safety: negation is allowed here."""
        check_aggregates(q.body, self.relations)
        if self._tables is not None:
            return self._query_local(q, cap)
        with wrapping(self.spark):
            body = Body(self.spark, self.relations, lambda k, n: self._read(n), support=True)
            state = body.compile(q.body, q.outputs)
            outputs, types = [], []
            for i, e in enumerate(q.outputs):
                value, kind = body.value(state, e)
                outputs.append(value.cast(SPARK_TYPES[kind or INT]).alias(f"o{i}"))
                types.append(kind or INT)
            rows = state.df.select(*outputs, _why(state.support).alias("support"))
        # written once with its faults and its count: no plan is evaluated twice
        stored, rows, n = Stored(self.spark, rows.schema).add(rows.limit(cap + 1) if cap <= LIMIT_ROWS else rows, state.faults)
        names = [f"o{i}" for i in range(len(types))]
        frame = (rows.limit(cap) if n > cap else rows).groupBy(*names).agg(F.collect_list("support").alias("justifications"))
        return QueryResult(self.spark, types, n > cap, frame)

    def _query_local(self, q: ConjunctiveQuery, cap: int) -> QueryResult:
        found: dict[tuple, list[Support]] = {}
        types: list[str] | None = None
        n = 0
        truncated = False
        for env, support in local.solve(q.body, lambda k, name: self._tables[name]):
            if n == cap:
                truncated = True
                break
            n += 1
            row = tuple(local.typed(e, env) for e in q.outputs)
            types = types or [type_of(v) for v in row]
            found.setdefault(row, []).append(support)
        return QueryResult(self.spark, types or self._output_types(q), truncated, found=found)

    def _output_types(self, q: ConjunctiveQuery) -> list[str]:
        from lakelog.plans.typing_ import body_types

        env, out = body_types(q.body, self.relations), []
        for e in q.outputs:
            try:
                out.append(infer(e, env))
            except ExprFault:
                out.append(INT)
        return out

    def explain(self, relation: str, values: Iterable[Value], cap: int = DEFAULT_CAP) -> Explanation:
        """The one-step derivations of the tuple (of a lattice: of its key) by the rules, at most
        ``cap``.  A tuple that can't be in the relation, by its types or length, has none."""
        r = self.relations.get(relation)
        if r is None:
            raise UnknownRelation(f"unknown relation {relation}")
        values = tuple(values)
        out = Explanation()
        want = values[: len(values) - 1 if r.lattice else len(values)]
        fits = all(v is not None and type_of(v) == t and (t != INT or -(2**63) <= v < 2**63) for v, t in zip(want, r.types))
        if len(values) != len(r.types) or not fits:
            return out
        for k, rule in enumerate(self.program.rules):
            for head in rule.heads:
                if head.relation == relation:
                    found = self._explained(rule, head, want, cap + 1 - len(out))
                    out += [Derivation(k, s) for s in found]
                    if len(out) > cap:
                        out.truncated = True
                        del out[cap:]
                        return out
        out.sort(key=repr)
        return out

    def _explained(self, rule, head, want: tuple, most: int) -> list[Support]:
        if self._tables is not None:
            tables = self._tables
            found = (s for env, s in local.solve(rule.body, lambda k, n: tables[n]) if tuple(local.typed(e, env) for e in head.exprs)[: len(want)] == want)
            return list(islice(found, most))
        with wrapping(self.spark):
            body = Body(self.spark, self.relations, lambda k, n: self._read(n), support=True)
            state = body.compile(rule.body, head.exprs)
            wanted = []
            for i, e in enumerate(head.exprs):  # a fault in any of them counts
                value, _ = body.value(state, e)
                if i < len(want):
                    wanted.append(value == literal(want[i]))
            rows = reduce(DataFrame.filter, wanted, state.df).select(_why(state.support).alias("s")).limit(most)
            rows = Stored(self.spark, rows.schema).add(rows, state.faults)[1] if state.faults else rows
            return [_support(r.s) for r in rows.collect()]

    # -- the protocol of fact stores
    def eval(self, query: ConjunctiveQuery, max: int) -> tuple[DataFrame, DataFrame]:
        """The rows of a checked query, and the rows with their justifications."""
        result = self.query(query, cap=max)
        return result.df, result.provenance

    # -- sources
    def ingest(self, source, expected: dict[str, str] | None = None) -> str:
        """All predicates of a FactSource; returns its content id.  ``expected``: the fingerprints
        that the host was built against, by predicate; where it has none, those of a predicate's
        first batch.  Everything is checked before anything is added."""
        found, seen = [], {}
        for d in source.schema():
            if d.name not in self.relations:
                raise SchemaError(f"no relation {d.name} for the source's predicate")
            d.validate(self.relations[d.name].types, (expected or {}).get(d.name, self._seen.get(d.name, d.fingerprint)))
            frame = source.to_dataframe(self.spark, d)
            d.validate_frame(frame)
            seen[d.name] = d.fingerprint
            found.append((d.name, frame))
        for name, frame in found:
            self.add_dataframe(name, frame)
        self._seen |= seen
        return source.content_id()

    def free(self) -> None:
        """Forget all tuples and delete what was stored of them; DataFrames that were handed out
        can't be read any more."""
        for k in self._kept.values():
            k.stored.remove()
        self._tables = {n: local.Table(r) for n, r in self.relations.items()} if self.local_rows else None
        self._start()


def _why(support: list[tuple[str, str]]) -> Column:
    return F.array(*[F.col(c) for _, c in support]) if support else F.array().cast(_WHY)


__all__ = ["Consequences", "Derivation", "Engine", "Explanation", "QueryResult", "RelationSchema", "compile_expr"]
