"""Strata over DataFrames: one pass where nothing is recursive, else semi-naive passes.

A relation that is recursive, that several clauses read, or whose rules can fail is stored as
Parquet folders in the shared folder; others stay plans, so that filters reach their scans.
A pass joins what the last pass added with the full relations (one variant of a rule for
each of its recursive atoms), takes out what is known by an anti join, and writes the rest
as the next folder: lineage never grows, and a lost executor costs a re-read.

A later run starts from what is new since the last one: a rule is evaluated with one variant
for each atom of a relation that changed, as a whole only if it negates or aggregates one,
and not at all if it reads none.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelog.errors import ExprFault, IterationLimit
from lakelog.functions.exprs import SPARK_TYPES, wrapping
from lakelog.operators.body import Body
from lakelog.operators.materialize import Stored
from lakelog.plans.ir import Agg, Head, Match, Negated, Relation, Rule
from lakelog.plans.stratify import Stratum


def schema(relation: Relation) -> T.StructType:
    return T.StructType([T.StructField(c, SPARK_TYPES[t]) for c, t in zip(relation.columns, relation.types)])


def unique(relation: Relation, rows: DataFrame) -> DataFrame:
    """Rows of a relation without duplicates; of a lattice the join of each key's values."""
    if not relation.lattice:
        return rows.distinct()
    *keys, value = relation.columns
    join = (F.max if relation.lattice == "max" else F.min)(value).alias(value)
    return rows.groupBy(*keys).agg(join).filter(F.col(value).isNotNull())


def news(relation: Relation, rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (a lattice's cells) that change the relation."""
    if not relation.lattice:
        return rows.distinct().join(known, relation.columns, "left_anti")
    *keys, value = relation.columns
    old = known.select(*keys, F.col(value).alias("old"))
    best = unique(relation, rows)
    joined = best.join(old, keys, "left") if keys else best.join(old, F.lit(True), "left")
    better = F.col(value) > F.col("old") if relation.lattice == "max" else F.col(value) < F.col("old")
    return joined.filter(F.col("old").isNull() | better).select(*keys, value)


Faults = list[tuple[ExprFault, DataFrame]]


class Kept:
    """A relation between runs: a plan, stored rows, or both; neither overlaps the other."""

    def __init__(self, spark: SparkSession, relation: Relation, plan: DataFrame | None = None, stored: Stored | None = None):
        self.spark, self.relation, self.plan = spark, relation, plan
        self.stored = stored or Stored(spark, schema(relation))

    def read(self) -> DataFrame:
        if self.plan is None:
            rows = self.stored.read()
        elif self.stored.paths:
            rows = self.plan.unionByName(self.stored.read())
        else:
            return self.plan
        # a set's folders don't overlap; of a lattice's cells the joined value counts
        return unique(self.relation, rows) if self.relation.lattice else rows

    def add(self, rows: DataFrame, faults: Faults = ()) -> tuple[Kept, DataFrame, int]:
        """With the rows that change it; those rows; how many they are."""
        stored, added, n = self.stored.add(rows, faults)
        return Kept(self.spark, self.relation, self.plan, stored), added, n

    def settled(self) -> Kept:
        """Without a plan: the rows are stored."""
        if self.plan is None:
            return self
        return Kept(self.spark, self.relation, None, Stored(self.spark, schema(self.relation)).add(self.read())[0])


def derive(spark: SparkSession, relations: dict[str, Relation], rule: Rule, head: Head, scan) -> tuple[DataFrame, Faults]:
    """What the rule derives for one head, and where rows that reach an expression fail there."""
    body = Body(spark, relations, scan)
    state = body.compile(rule.body, head.exprs)
    out = []
    relation = relations[head.relation]
    for c, t, e in zip(relation.columns, relation.types, head.exprs):
        value, _ = body.value(state, e)
        out.append(value.cast(SPARK_TYPES[t]).alias(c))
    return state.df.select(*out), state.faults


def run(spark: SparkSession, relations: dict[str, Relation], strata: list[Stratum], db: dict[str, Kept], max_iterations: int, new: dict[str, DataFrame] | None = None) -> tuple[dict[str, Kept], dict[str, DataFrame]]:
    """The database with all rules at their fixed point, and what was added to each relation
    that changed; ``db`` itself isn't changed.  ``new``: rows asserted since the last run, not in
    ``db`` yet; None for a first run, which evaluates everything and doesn't say what it added."""
    db = dict(db)
    changed: dict[str, DataFrame] | None = None
    with wrapping(spark):
        if new is not None:
            changed = {}
            for name, rows in new.items():
                db[name], added, n = db[name].add(news(relations[name], rows, db[name].read()))
                if n:
                    changed[name] = added
        readers = Counter(name for s in strata for _, r, _ in s.rules for name in _reads(r))
        for stratum in strata:
            if not stratum.recursive:
                _once(spark, relations, stratum, db, changed, readers)
            else:
                _loop(spark, relations, stratum, db, changed, max_iterations)
    return db, changed or {}


def _reads(rule: Rule) -> list[str]:
    return [c.atom.relation for c in rule.body if isinstance(c, (Match, Negated, Agg))]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _turns(rule: Rule, changed: dict[str, DataFrame] | None) -> list[int | None]:
    """Which atoms of the rule read only what changed, a variant each; None stands for none of them."""
    if changed is None:
        return [None]
    if any(isinstance(c, (Negated, Agg)) and c.atom.relation in changed for c in rule.body):
        return [None]
    return [k for k, c in enumerate(rule.body) if isinstance(c, Match) and c.atom.relation in changed]


def _found(spark: SparkSession, relations: dict[str, Relation], stratum: Stratum, full: dict[str, DataFrame], turns) -> dict[str, tuple[DataFrame, Faults]]:
    """What the rules derive for each relation, with their faults.  ``turns``: (rule) -> (number
    of an atom or None, the rows it reads) of each variant."""
    out: dict[str, tuple[list[DataFrame], Faults]] = {}
    for _, rule, head in stratum.rules:
        for turn, delta in turns(rule):
            scan = lambda k, n, turn=turn, delta=delta: delta if k == turn and turn is not None else full[n]
            rows, faults = derive(spark, relations, rule, head, scan)
            found = out.setdefault(head.relation, ([], []))
            found[0].append(rows)
            found[1].extend(faults)
    return {n: (_union(rows), faults) for n, (rows, faults) in out.items()}


def _reader(db: dict[str, Kept]) -> dict[str, DataFrame]:
    class Full(dict):
        def __missing__(self, name: str) -> DataFrame:
            self[name] = db[name].read()
            return self[name]

    return Full()


def _once(spark: SparkSession, relations: dict[str, Relation], stratum: Stratum, db: dict[str, Kept], changed: dict[str, DataFrame] | None, readers: Counter) -> None:
    turns = lambda rule: [(k, None if k is None else changed[rule.body[k].atom.relation]) for k in _turns(rule, changed)]
    for name, (rows, faults) in _found(spark, relations, stratum, _reader(db), turns).items():
        relation = relations[name]
        if changed is not None:
            db[name], added, n = db[name].add(news(relation, rows, db[name].read()), faults)
            if n:
                # facts asserted for the relation itself are new as well
                changed[name] = unique(relation, _union([changed[name], added])) if name in changed else added
            continue
        whole = unique(relation, _union([db[name].read(), rows]))
        if faults or readers[name] > 1:
            db[name] = Kept(spark, relation, None, Stored(spark, schema(relation)).add(whole, faults)[0])
        else:
            db[name] = Kept(spark, relation, whole)


def _loop(spark: SparkSession, relations: dict[str, Relation], stratum: Stratum, db: dict[str, Kept], changed: dict[str, DataFrame] | None, max_iterations: int) -> None:
    """Semi-naive passes.  ``delta``: what the last pass added, of the relations it changed."""
    inner = set(stratum.relations)
    if changed is None:
        delta: dict[str, DataFrame] = {}
        for name in stratum.relations:
            db[name] = db[name].settled()
        turns = lambda rule: [(None, None)]
    else:
        delta = dict(changed)
        turns = lambda rule: [(k, None if k is None else delta[rule.body[k].atom.relation]) for k in _turns(rule, delta)]
    gained: dict[str, list[DataFrame]] = {n: [changed[n]] for n in inner if changed and n in changed}
    passes = 0
    while True:
        step: dict[str, DataFrame] = {}
        after = dict(db)
        for name, (rows, faults) in _found(spark, relations, stratum, _reader(db), turns).items():
            after[name], added, n = db[name].add(news(relations[name], rows, db[name].read()), faults)
            if n:
                step[name] = added
                gained.setdefault(name, []).append(added)
        db.update({n: after[n] for n in inner})
        if not step:
            break
        passes += 1
        if passes > max_iterations:
            raise IterationLimit(f"no fixed point after {max_iterations} passes")
        delta = step
        # only atoms of the stratum itself change from here on
        turns = lambda rule: [(k, delta[c.atom.relation]) for k, c in enumerate(rule.body) if isinstance(c, Match) and c.atom.relation in delta]
    if changed is not None:
        for name, rows in gained.items():
            changed[name] = unique(relations[name], _union(rows)) if len(rows) > 1 and relations[name].lattice else _union(rows)
