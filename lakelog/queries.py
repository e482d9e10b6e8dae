"""One registered query per operator of the engine, with the same in DuckDB's SQL.

A query is a program, the tables its relations are read from, and what is returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.engine import Engine
from lakelog.errors import LakelogError
from lakelog.sources.parquet import ParquetSource, elements, facts
from lakelog.sources.source import PredicateDescriptor


@dataclass
class Spec:
    """``inputs``: relation -> (table, columns, whether rows are unique); money columns are
    scaled to cents.  ``out``: the relation returned, ``names`` its columns."""

    program: str
    inputs: dict[str, tuple[str, str, bool]]
    out: str
    names: str
    sql: str
    scale: dict[str, int] = field(default_factory=dict)

    def engine(self, spark: SparkSession, sf_dir: str) -> Engine:
        engine = Engine.from_source(spark, self.program, local_rows=0)
        for relation, (table, columns, distinct) in self.inputs.items():
            rows = facts(spark.read.parquet(f"{sf_dir}/{table}.parquet"), *columns.split(), scale=self.scale)
            engine.add_dataframe(relation, rows, nulls="drop", distinct=not distinct)
        return engine

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.engine(spark, sf_dir).run().relation(self.out).toDF(*self.names.split())


_NATION = {"nation": ("nation", "n_nationkey n_name n_regionkey", True)}
_REGION = {"region": ("region", "r_regionkey r_name", True)}
_CUSTOMER = {"customer": ("customer", "c_custkey c_nationkey", True)}
_SUPPLIER = {"supplier": ("supplier", "s_suppkey s_nationkey", True)}
_PART = {"part": ("part", "p_partkey p_brand p_size", True)}
_ORDER = {"ord": ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice", True)}
_ITEM = {"item": ("lineitem", "l_orderkey l_linenumber l_partkey l_suppkey l_quantity", True)}
_TURN = {"turn": ("conversations", "conv_id turn role", True)}
_CENTS = {"o_totalprice": 2, "c_acctbal": 2}

_D_NATION = "relation nation(int, sym, int);"
_D_REGION = "relation region(int, sym);"
_D_CUSTOMER = "relation customer(int, int);"
_D_SUPPLIER = "relation supplier(int, int);"
_D_PART = "relation part(int, sym, int);"
_D_ORDER = "relation ord(int, int, sym, int);"
_D_ITEM = "relation item(int, int, int, int, int);"
_D_TURN = "relation turn(int, int, sym);"
_NEXT = _D_TURN + "relation next(int, int, int); next(c, t, u) <-- turn(c, t, _), let u = t + 1, turn(c, u, _);"
_REACH_SQL = "WITH RECURSIVE r AS (SELECT a.conv_id AS conv, a.turn AS from_turn, b.turn AS to_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 UNION SELECT r.conv, r.from_turn, c.turn FROM r JOIN conversations c ON c.conv_id = r.conv AND c.turn = r.to_turn + 1) SELECT * FROM r"
_HOP = "((a.n_nationkey * 7 + b.n_nationkey * 3) % 11 + 1)"

SPECS: dict[str, Spec] = {
    "scan": Spec(_D_NATION + "relation out(int, sym, int); out(k, n, r) <-- nation(k, n, r);", _NATION, "out", "k n r", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation"),
    "projection": Spec(_D_ORDER + "relation out(int, sym); out(c, s) <-- ord(_, c, s, _);", _ORDER, "out", "c s", "SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders", _CENTS),
    "literal_filter": Spec(_D_ORDER + 'relation out(int, int); out(k, p) <-- ord(k, _, "F", p);', _ORDER, "out", "k p", "SELECT o_orderkey AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE o_orderstatus = 'F'", _CENTS),
    "literal_mismatch": Spec(_D_NATION + 'relation out(int); out(k) <-- nation(k, 7, _); out(k) <-- nation(k, _, "1");', _NATION, "out", "k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE false"),
    "self_eq": Spec("relation pair(int, int); relation out(int); out(x) <-- pair(x, x);", {"pair": ("lineitem", "l_suppkey l_linenumber", False)}, "out", "x", "SELECT DISTINCT l_suppkey AS x FROM lineitem WHERE l_suppkey = l_linenumber"),
    "if_filter": Spec(_D_PART + "relation out(int, int); out(k, s) <-- part(k, _, s), if s > 20 && s <= 30 || s == 7;", _PART, "out", "k s", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size > 20 AND p_size <= 30 OR p_size = 7"),
    "let_arith": Spec(_D_PART + "relation out(int, int, int); out(k, a, b) <-- part(k, _, s), let a = s * 3 - k, let b = -(a + 1);", _PART, "out", "k a b", "SELECT p_partkey AS k, CAST(p_size * 3 - p_partkey AS BIGINT) AS a, CAST(-(p_size * 3 - p_partkey + 1) AS BIGINT) AS b FROM part"),
    "let_shadow": Spec(_D_PART + "relation out(int, int); out(k, s) <-- part(k, _, s), let s = s + 1, let s = s * 2;", _PART, "out", "k s", "SELECT p_partkey AS k, CAST((p_size + 1) * 2 AS BIGINT) AS s FROM part"),
    "div_rem": Spec(_D_PART + "relation out(int, int, int); out(k, q, r) <-- part(k, _, s), let d = s - 25, if d != 0, let q = (0 - k) / d, let r = (0 - k) % d;", _PART, "out", "k q r", "SELECT p_partkey AS k, CAST((0 - p_partkey) // (p_size - 25) AS BIGINT) AS q, CAST((0 - p_partkey) % (p_size - 25) AS BIGINT) AS r FROM part WHERE p_size <> 25"),
    "bool_logic": Spec(_D_PART + "relation out(int, bool, bool); out(k, a, b) <-- part(k, n, s), let a = s > 10 && !(s == 20), let b = a || n == \"Brand#11\";", _PART, "out", "k a b", "SELECT p_partkey AS k, p_size > 10 AND NOT (p_size = 20) AS a, (p_size > 10 AND NOT (p_size = 20)) OR p_brand = 'Brand#11' AS b FROM part"),
    "bool_facts": Spec("relation label(int, bool, bool); relation out(int); out(d) <-- label(d, true, x), if !x;", {}, "out", "d", "SELECT doc_id AS d FROM labels WHERE quality = 1 AND toxic = 0"),
    "constant": Spec("relation out(int, sym, bool); out(1, \"a\", false) <-- if true; out(2 + 3, \"b\", 1 < 2) <-- let x = 1, if x == 1;", {}, "out", "i s b", "SELECT CAST(1 AS BIGINT) AS i, 'a' AS s, false AS b UNION ALL SELECT 5, 'b', true"),
    "join2": Spec(_D_NATION + _D_CUSTOMER + "relation out(int, sym); out(c, n) <-- customer(c, k), nation(k, n, _);", _NATION | _CUSTOMER, "out", "c n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "join3": Spec(_D_NATION + _D_CUSTOMER + _D_REGION + 'relation out(int, sym); out(c, n) <-- customer(c, k), nation(k, n, r), region(r, "ASIA");', _NATION | _CUSTOMER | _REGION, "out", "c n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "join_big": Spec(_D_ITEM + _D_ORDER + _D_CUSTOMER + 'relation out(int, int, int); out(o, l, n) <-- ord(o, c, "F", p), if p > 20000000, item(o, l, _, _, q), if q > 40, customer(c, n);', _ITEM | _ORDER | _CUSTOMER, "out", "o l n", "SELECT DISTINCT o_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, CAST(c_nationkey AS BIGINT) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND CAST(ROUND(o_totalprice * 100) AS BIGINT) > 20000000 AND l_quantity > 40", _CENTS),
    "self_join": Spec(_D_TURN + "relation out(int, int, int); out(c, t, u) <-- turn(c, t, r), turn(c, u, r), if t < u;", _TURN, "out", "c t u", "SELECT a.conv_id AS c, a.turn AS t, b.turn AS u FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn"),
    "cross_join": Spec(_D_REGION + _D_NATION + "relation out(sym, sym); out(a, b) <-- region(_, a), nation(_, b, _);", _REGION | _NATION, "out", "a b", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "theta_join": Spec(_D_NATION + "relation out(int, int); out(a, b) <-- nation(a, _, r), nation(b, _, s), if r != s, if a < b;", _NATION, "out", "a b", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "range_join": Spec(_D_NATION + _D_PART + "relation out(int, int); out(k, n) <-- part(k, \"Brand#11\", s), nation(n, _, r), if n * 2 <= s, if s < n * 2 + 2;", _NATION | _PART, "out", "k n", "SELECT p_partkey AS k, CAST(n_nationkey AS BIGINT) AS n FROM part JOIN nation ON n_nationkey * 2 <= p_size AND p_size < n_nationkey * 2 + 2 WHERE p_brand = 'Brand#11'"),
    "semi": Spec(_D_CUSTOMER + _D_ORDER + 'relation out(int); out(c) <-- customer(c, _), ord(_, c, "O", _);', _CUSTOMER | _ORDER, "out", "c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')", _CENTS),
    "anti_join": Spec(_D_CUSTOMER + _D_ORDER + 'relation out(int); out(c) <-- customer(c, _), !ord(_, c, "P", _);', _CUSTOMER | _ORDER, "out", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", _CENTS),
    "anti_unbound": Spec(_D_REGION + _D_NATION + 'relation out(sym); out(n) <-- region(_, n), !nation(x, "NOWHERE", x);', _REGION | _NATION, "out", "n", "SELECT r_name AS n FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NOWHERE')"),
    "union_rules": Spec(_D_CUSTOMER + _D_SUPPLIER + "relation out(int); out(n) <-- customer(_, n); out(n) <-- supplier(_, n);", _CUSTOMER | _SUPPLIER, "out", "n", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": Spec(_D_CUSTOMER + _D_SUPPLIER + "relation out(int); out(k) <-- customer(k, n), supplier(k, n);", _CUSTOMER | _SUPPLIER, "out", "k", "SELECT k FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer INTERSECT SELECT s_suppkey, s_nationkey FROM supplier)"),
    "except": Spec(_D_CUSTOMER + _D_SUPPLIER + "relation out(int, int); out(k, n) <-- customer(k, n), !supplier(k, n);", _CUSTOMER | _SUPPLIER, "out", "k n", "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS n FROM customer EXCEPT SELECT s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier"),
    "multi_head": Spec(_D_NATION + "relation a(int); relation b(sym); relation out(int, sym); a(k), b(n) <-- nation(k, n, 1); out(k, n) <-- nation(k, n, _), a(k), b(n);", _NATION, "out", "k n", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_regionkey = 1"),
    "agg_count": Spec(_D_CUSTOMER + _D_NATION + "relation out(int, int); out(k, m) <-- nation(k, _, _), agg m = count() in customer(_, k);", _CUSTOMER | _NATION, "out", "k m", "SELECT CAST(n_nationkey AS BIGINT) AS k, count(c_custkey) AS m FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "agg_sum": Spec(_D_CUSTOMER + _D_ORDER + "relation out(int, int); out(c, t) <-- customer(c, _), agg t = sum(p) in ord(_, c, _, p);", _CUSTOMER | _ORDER, "out", "c t", "SELECT c_custkey AS c, CAST(coalesce(sum(CAST(ROUND(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", _CENTS),
    "agg_min": Spec(_D_CUSTOMER + _D_ORDER + "relation out(int, int); out(c, t) <-- customer(c, _), agg t = min(p) in ord(_, c, _, p);", _CUSTOMER | _ORDER, "out", "c t", "SELECT o_custkey AS c, min(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS t FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", _CENTS),
    "agg_max": Spec(_D_SUPPLIER + _D_ITEM + "relation out(int, int); out(s, t) <-- supplier(s, _), agg t = max(q) in item(_, _, _, s, q);", _SUPPLIER | _ITEM, "out", "s t", "SELECT l_suppkey AS s, CAST(max(l_quantity) AS BIGINT) AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
    "agg_global": Spec(_D_ITEM + "relation out(int, int, int, int); out(a, b, c, d) <-- agg a = count() in item(_, _, _, _, _), agg b = sum(q) in item(_, _, _, _, q), agg c = min(q) in item(_, _, _, _, q), agg d = max(q) in item(_, _, _, _, q);", _ITEM, "out", "a b c d", "SELECT count(*) AS a, CAST(sum(l_quantity) AS BIGINT) AS b, CAST(min(l_quantity) AS BIGINT) AS c, CAST(max(l_quantity) AS BIGINT) AS d FROM lineitem"),
    "agg_empty_group": Spec(_D_CUSTOMER + _D_NATION + "relation out(int, int, int); out(k, m, s) <-- nation(k, _, _), let z = k + 100, agg m = count() in customer(_, z), agg s = sum(c) in customer(c, z); out(k, 1, 1) <-- nation(k, _, _), let z = k + 100, agg m = max(c) in customer(c, z);", _CUSTOMER | _NATION, "out", "k m s", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS s FROM nation"),
    "agg_outer_var": Spec(_D_NATION + _D_PART + "relation out(int, int); out(k, t) <-- nation(k, _, _), agg t = sum(s * k) in part(_, \"Brand#11\", s);", _NATION | _PART, "out", "k t", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(coalesce(sum(p_size * n_nationkey) FILTER (WHERE p_brand = 'Brand#11'), 0) AS BIGINT) AS t FROM nation, part GROUP BY 1"),
    "agg_no_arg": Spec(_D_NATION + "relation out(int, int); out(k, t) <-- nation(k, _, _), agg t = sum() in nation(_, _, k); out(k, 9) <-- nation(k, _, _), agg t = min() in nation(_, _, k);", _NATION, "out", "k t", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(0 AS BIGINT) AS t FROM nation"),
    "agg_bool": Spec("relation label(int, bool, bool); relation out(int, int); out(a, b) <-- agg a = sum(q) in label(_, q, _), agg b = max(t) in label(_, _, t);", {}, "out", "a b", "SELECT CAST(sum(quality) AS BIGINT) AS a, CAST(max(toxic) AS BIGINT) AS b FROM labels"),
    "having": Spec(_D_CUSTOMER + _D_ORDER + "relation out(int, int); out(c, n) <-- customer(c, _), agg n = count() in ord(_, c, _, _), if n > 12;", _CUSTOMER | _ORDER, "out", "c n", "SELECT o_custkey AS c, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12", _CENTS),
    "rank_by_count": Spec(_D_NATION + "relation out(int, int); out(k, n) <-- nation(k, _, r), agg n = count() in smaller(k, _); relation smaller(int, int); smaller(a, b) <-- nation(a, _, r), nation(b, _, r), if b < a;", _NATION, "out", "k n", "SELECT CAST(n_nationkey AS BIGINT) AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation"),
    "stratified_negation": Spec(_D_NATION + "relation p(int); relation q(int); relation out(int); p(k) <-- nation(k, _, r), if r > 1; q(k) <-- nation(k, _, _), !p(k); out(k) <-- q(k), !nation(k, _, 0);", _NATION, "out", "k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey <= 1 AND n_regionkey <> 0"),
    "default_deny": Spec(_D_NATION + "relation policy::grant(int); relation policy::deny(int); relation user::deny(int); relation allowed(int); policy::grant(k) <-- nation(k, _, r), if r < 3; policy::deny(k) <-- nation(k, _, 1); user::deny(k) <-- nation(k, _, _), if k % 2 == 1; allowed(k) <-- nation(k, _, _), policy::grant(k), !policy::deny(k), !user::deny(k);", _NATION, "allowed", "k", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_regionkey IN (0, 2) AND n_nationkey % 2 = 0"),
    "recursion_chain": Spec(_NEXT + "relation reach(int, int, int); reach(c, a, b) <-- next(c, a, b); reach(c, a, d) <-- reach(c, a, b), next(c, b, d);", _TURN, "reach", "conv from_turn to_turn", _REACH_SQL),
    "recursion_nonlinear": Spec(_NEXT + "relation reach(int, int, int); reach(c, a, b) <-- next(c, a, b); reach(c, a, d) <-- reach(c, a, b), reach(c, b, d);", _TURN, "reach", "conv from_turn to_turn", _REACH_SQL),
    "recursion_mutual": Spec(_NEXT + "relation even(int, int); relation odd(int, int); even(c, 0) <-- turn(c, 0, _); odd(c, u) <-- even(c, t), next(c, t, u); even(c, u) <-- odd(c, t), next(c, t, u); relation out(int, int, bool); out(c, t, true) <-- even(c, t); out(c, t, false) <-- odd(c, t);", _TURN, "out", "c t even", "SELECT conv_id AS c, turn AS t, turn % 2 = 0 AS even FROM conversations a WHERE (SELECT count(DISTINCT turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn) = turn + 1"),
    "recursion_cyclic": Spec(_D_NATION + "relation e(int, int); relation reach(int, int); e(a, b) <-- nation(a, _, r), nation(b, _, r), if (a - b) * (a - b) < 100; reach(a, b) <-- e(a, b); reach(a, c) <-- e(a, b), reach(b, c);", _NATION, "reach", "a b", "WITH RECURSIVE e AS (SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_nationkey - b.n_nationkey) * (a.n_nationkey - b.n_nationkey) < 100), r AS (SELECT * FROM e UNION SELECT e.a, r.b FROM e JOIN r ON e.b = r.a) SELECT * FROM r"),
    "lattice_max": Spec(_D_ORDER + "lattice best(int, int); best(c, p) <-- ord(_, c, _, p);", _ORDER, "best", "c p", "SELECT o_custkey AS c, max(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS p FROM orders GROUP BY 1", _CENTS),
    "lattice_min": Spec(_D_ORDER + "lattice least(int, dual int); least(c, Dual(p)) <-- ord(_, c, _, p);", _ORDER, "least", "c p", "SELECT o_custkey AS c, min(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS p FROM orders GROUP BY 1", _CENTS),
    "lattice_keyless": Spec(_D_ORDER + "lattice best(int); best(p) <-- ord(_, _, _, p);", _ORDER, "best", "p", "SELECT max(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS p FROM orders", _CENTS),
    "lattice_read": Spec(_D_ORDER + "lattice best(int, int); best(c, p) <-- ord(_, c, _, p); relation out(int, int); out(c, p + 1) <-- best(c, ?p), if p > 30000000;", _ORDER, "out", "c p", "SELECT o_custkey AS c, max(CAST(ROUND(o_totalprice * 100) AS BIGINT)) + 1 AS p FROM orders GROUP BY 1 HAVING max(CAST(ROUND(o_totalprice * 100) AS BIGINT)) > 30000000", _CENTS),
    "shortest_path": Spec(_D_NATION + "relation e(int, int, int); lattice sp(int, int, dual int); e(a, b, (a * 7 + b * 3) % 11 + 1) <-- nation(a, _, r), nation(b, _, r), if a != b; sp(a, b, w) <-- e(a, b, w); sp(a, c, w + l) <-- e(a, b, w), sp(b, c, ?Dual(l));", _NATION, "sp", "a b w", f"WITH RECURSIVE e AS (SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b, CAST({_HOP} AS BIGINT) AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), p AS (SELECT a, b, w, 1 AS n FROM e UNION SELECT e.a, p.b, e.w + p.w, n + 1 FROM e JOIN p ON e.b = p.a WHERE n < 6) SELECT a, b, min(w) AS w FROM p GROUP BY 1, 2"),
}


# ---- queries that aren't a program's relation

def _labels(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Flags of ``labels`` lowered to bool."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = SPECS[name]
        engine = Engine.from_source(spark, spec.program, local_rows=0)
        flags = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality") == 1, F.col("toxic") == 1)
        engine.add_dataframe("label", flags, nulls="drop")
        return engine.run().relation(spec.out).toDF(*spec.names.split())

    return query


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ad-hoc query: distinct rows."""
    result = SPECS["join3"].engine(spark, sf_dir).query('(n, r) <-- customer(c, k), nation(k, n, r), region(r, "ASIA")', cap=1_000_000_000)
    return result.df.toDF("n", "r")


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many justifications each row of a query has."""
    result = SPECS["join3"].engine(spark, sf_dir).query('(n, r) <-- customer(c, k), nation(k, n, r), region(r, "ASIA")', cap=1_000_000_000)
    return result.provenance.select(F.col("o0").alias("n"), F.size("justifications").cast("bigint").alias("m"), F.size(F.element_at("justifications", 1)).cast("bigint").alias("atoms"))


def query_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ad-hoc query with an aggregate and a computed output."""
    result = SPECS["agg_count"].engine(spark, sf_dir).query("(k, m * 2 + 1) <-- nation(k, _, _), agg m = count() in customer(_, k), if m > 0", cap=1_000_000_000)
    return result.df.toDF("k", "m")


def query_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap counts solutions; which ones is open, so only the number is returned."""
    result = SPECS["join2"].engine(spark, sf_dir).query("(c) <-- customer(c, _)", cap=100)
    return result.df.groupBy().agg(F.count("*").alias("n")).withColumn("truncated", F.lit(result.truncated))


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step derivations of a derived tuple."""
    engine = SPECS["recursion_chain"].engine(spark, sf_dir).run()
    rows = [(d.rule, s[0][1][1], s[0][1][2], s[1][1][2]) for d in engine.explain("reach", (0, 0, 2)) for s in [d.support] if len(s) == 2]
    return spark.createDataFrame(rows, "rule long, a long, b long, c long")


def speculate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one more fact would add."""
    engine = SPECS["recursion_cyclic"].engine(spark, sf_dir).run()
    return engine.speculate([("nation", (1000, "ATLANTIS", 0)), ("e", (1000, 0))]).added("reach").toDF("a", "b")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run continues from the first one's state; counts of both stay."""
    engine = SPECS["agg_count"].engine(spark, sf_dir).run()
    engine.add_fact("customer", (-1, 3))
    return engine.run().relation("out").toDF("k", "m")


def side_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as an indexed side relation, scaled to integers."""
    engine = Engine.from_source(spark, "relation vec(int, int, int); relation out(int, int); out(v, x) <-- vec(v, 0, x), agg m = max(y) in vec(v, _, y), if x == m;", local_rows=0)
    engine.add_dataframe("vec", elements(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 3), nulls="drop", distinct=False)
    return engine.run().relation("out").toDF("v", "x")


def fact_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion through descriptors with drift checks."""
    source = ParquetSource(spark, {"nation": (f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"], "nations"), "region": (f"{sf_dir}/region.parquet", ["r_regionkey", "r_name"], "regions")})
    engine = Engine.from_source(spark, _D_NATION + _D_REGION + "relation out(sym, sym); out(n, m) <-- nation(_, n, r), region(r, m);", local_rows=0)
    engine.ingest(source)
    return engine.run().relation("out").toDF("n", "m")


def _said(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "what string, found string")


def _error(f) -> str:
    """The class of the error that a call ends with."""
    try:
        f()
    except LakelogError as e:
        return type(e).__name__
    return "none"


def cap_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of nothing: no rows, and truncated as there are solutions."""
    result = SPECS["join2"].engine(spark, sf_dir).query("(c) <-- customer(c, _)", cap=0)
    return result.df.groupBy().agg(F.count("*").alias("n")).withColumn("truncated", F.lit(result.truncated))


def cap_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap that holds where none is given; it counts solutions, not rows."""
    result = SPECS["agg_max"].engine(spark, sf_dir).query("(o, l) <-- item(o, l, _, _, _)")
    return result.provenance.agg(F.sum(F.size("justifications")).alias("n")).withColumn("truncated", F.lit(result.truncated))


def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with their column types, by name."""
    rows = [(r.name, ", ".join(r.columns)) for r in SPECS["join3"].engine(spark, sf_dir).schema()]
    return spark.createDataFrame(rows, "name string, types string")


def check_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of form, without evaluation: range restriction, relations, arities, symbols in sums, syntax."""
    engine = SPECS["join3"].engine(spark, sf_dir)
    asked = {
        "right": "(c) <-- customer(c, _)",
        "output unbound": "(x) <-- customer(c, _)",
        "filter unbound": "(c) <-- customer(c, _), if z > 1",
        "negation": "(c) <-- customer(c, k), !nation(k, _, _)",
        "relation": "(c) <-- nothing(c)",
        "arity": "(c) <-- customer(c)",
        "symbols": "(x) <-- agg x = sum(n) in nation(_, n, _)",
        "syntax": "() <-- customer(c, _)",
    }
    return _said(spark, [(k, _error(lambda: engine.check(q))) for k, q in asked.items()])


def unknown_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown relation reads as empty; facts for it are an error."""
    engine = SPECS["join3"].engine(spark, sf_dir)
    return _said(spark, [("rows", str(engine.relation("nothing").count())), ("fact", _error(lambda: engine.add_fact("nothing", (1,))))])


def batch_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with one wrong fact adds none; a right one all."""
    engine = SPECS["join2"].engine(spark, sf_dir)
    _error(lambda: engine.add_facts([("customer", (-5, 1)), ("customer", (-6, "x"))]))
    engine.add_facts([("customer", (-7, 1)), ("customer", (-8, 1)), ("customer", (-8, 1))])
    return engine.run().relation("out").toDF("c", "n").filter("c < 0")


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from what was declared: arity, type, then fingerprint; nothing is added."""
    table = {"nation": (f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"], "nations")}
    found = ParquetSource(spark, table).schema()[0]
    engine = Engine.from_source(spark, _D_NATION, local_rows=0)
    declared = lambda columns, digest: [PredicateDescriptor(1, "nation", columns, "nations", digest)]
    tries = {
        "arity": lambda: ParquetSource(spark, table, declared=declared(("int", "sym"), found.fingerprint)),
        "type": lambda: ParquetSource(spark, table, declared=declared(("int", "int", "int"), found.fingerprint)),
        "fingerprint": lambda: ParquetSource(spark, table, declared=declared(found.columns, "09" * 32)),
        "host": lambda: engine.ingest(ParquetSource(spark, table), expected={"nation": "09" * 32}),
    }
    rows = [(k, _error(f)) for k, f in tries.items()]
    rows.append(("added", str(engine.relation("nation").count())))
    engine.ingest(ParquetSource(spark, table, declared=[found]))
    return _said(spark, [*rows, ("right", str(engine.relation("nation").count()))])


def explain_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice's cell is explained by its key: one derivation for each of the customer's orders."""
    engine = SPECS["lattice_max"].engine(spark, sf_dir).run()
    rows = [(d.support[0][1][0], d.support[0][1][3]) for d in engine.explain("best", (1, 0))]
    return spark.createDataFrame(rows, "k long, p long")


def explain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples that can't be there have no derivations; an unknown relation is an error."""
    engine = SPECS["join2"].engine(spark, sf_dir).run()
    asked = {"absent": (-1, "x"), "type": ("x", "x"), "arity": (1,), "base": (1, 2)}
    rows = [(k, str(len(engine.explain("customer" if k == "base" else "out", v)))) for k, v in asked.items()]
    return _said(spark, [*rows, ("relation", _error(lambda: engine.explain("nothing", (1,))))])


def iteration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursion that needs more passes than it may take is an error."""
    spec = SPECS["recursion_cyclic"]
    turns = facts(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", "n_name", "n_regionkey")
    engine = Engine.from_source(spark, spec.program, local_rows=0, max_iterations=1)
    engine.add_dataframe("nation", turns)
    return _said(spark, [("one pass", _error(engine.run))])


def speculate_before_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a run before, all that follows is new."""
    engine = SPECS["default_deny"].engine(spark, sf_dir)
    return engine.speculate([("nation", (102, "ATLANTIS", 0))]).added("allowed").toDF("k")


_ASIA = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"
_OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "query_rows": (query_rows, f"SELECT DISTINCT n_name AS n, CAST(n_regionkey AS BIGINT) AS r {_ASIA}"),
    "provenance_counts": (provenance_counts, f"SELECT n_name AS n, count(*) AS m, CAST(3 AS BIGINT) AS atoms {_ASIA} GROUP BY 1"),
    "query_aggregate": (query_aggregate, "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) * 2 + 1 AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "query_capped": (query_capped, "SELECT least(count(*), 100) AS n, count(*) > 100 AS truncated FROM customer"),
    "explain": (explain, "SELECT CAST(2 AS BIGINT) AS rule, CAST(0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, CAST(2 AS BIGINT) AS c WHERE (SELECT count(DISTINCT turn) FROM conversations WHERE conv_id = 0 AND turn <= 2) = 3"),
    "speculate_delta": (speculate_delta, "SELECT DISTINCT CAST(1000 AS BIGINT) AS a, b FROM (" + SPECS["recursion_cyclic"].sql + ") WHERE a = 0 UNION SELECT 1000, 0 UNION SELECT 1000, 1000"),
    "incremental": (incremental, "WITH c AS (" + SPECS["agg_count"].sql + ") SELECT * FROM c UNION SELECT k, m + 1 FROM c WHERE k = 3"),
    "side_relation": (side_relation, "SELECT vec_id AS v, CAST(ROUND(embedding[1] * 1000.0::FLOAT) AS BIGINT) AS x FROM embeddings WHERE ROUND(embedding[1] * 1000.0::FLOAT) = list_max(list_transform(embedding, lambda y: ROUND(y * 1000.0::FLOAT)))"),
    "cap_zero": (cap_zero, "SELECT CAST(0 AS BIGINT) AS n, count(*) > 0 AS truncated FROM customer"),
    "cap_default": (cap_default, "SELECT least(count(*), 10000) AS n, count(*) > 10000 AS truncated FROM lineitem"),
    "schema_listing": (schema_listing, "SELECT * FROM (VALUES ('customer', 'int, int'), ('nation', 'int, sym, int'), ('out', 'int, sym'), ('region', 'int, sym')) t(name, types)"),
    "check_only": (check_only, "SELECT * FROM (VALUES ('right', 'none'), ('output unbound', 'UnsafeError'), ('filter unbound', 'UnsafeError'), ('negation', 'UnsafeError'), ('relation', 'SchemaError'), ('arity', 'SchemaError'), ('symbols', 'ColumnType'), ('syntax', 'ParseError')) t(what, found)"),
    "unknown_relation": (unknown_relation, "SELECT * FROM (VALUES ('rows', '0'), ('fact', 'UnknownRelation')) t(what, found)"),
    "batch_assertion": (batch_assertion, "SELECT CAST(c AS BIGINT) AS c, n_name AS n FROM nation, (VALUES (-7), (-8)) t(c) WHERE n_nationkey = 1"),
    "drift": (drift, "SELECT * FROM (VALUES ('arity', 'ArityDrift'), ('type', 'ColumnTypeDrift'), ('fingerprint', 'FingerprintDrift'), ('host', 'FingerprintDrift'), ('added', '0')) t(what, found) UNION ALL SELECT 'right', CAST(count(*) AS VARCHAR) FROM nation"),
    "explain_lattice": (explain_lattice, "SELECT o_orderkey AS k, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS p FROM orders WHERE o_custkey = 1"),
    "explain_edges": (explain_edges, "SELECT * FROM (VALUES ('absent', '0'), ('type', '0'), ('arity', '0'), ('base', '0'), ('relation', 'UnknownRelation')) t(what, found)"),
    "iteration_cap": (iteration_cap, "SELECT 'one pass' AS what, 'IterationLimit' AS found"),
    "speculate_before_run": (speculate_before_run, "SELECT * FROM (" + SPECS["default_deny"].sql + ") UNION ALL SELECT CAST(102 AS BIGINT)"),
    "fact_source": (fact_source, "SELECT n_name AS n, r_name AS m FROM nation JOIN region ON n_regionkey = r_regionkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return SPECS | {n: _labels(n) for n in ("bool_facts", "agg_bool")} | {n: f for n, (f, _) in _OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s.sql for n, s in SPECS.items()} | {n: sql for n, (_, sql) in _OTHER.items()}
