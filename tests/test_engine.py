"""Semantics, on the local path and on Spark's alike."""

import os

import pytest

from lakelog import Engine
from lakelog.errors import Arithmetic, Arity, ColumnType, EvalError, ExprFault, IterationLimit, SchemaError, TypeMismatch, UnknownRelation, UnsafeError

TC = "relation edge(int, int); relation path(int, int); path(x, y) <-- edge(x, y); path(x, z) <-- edge(x, y), path(y, z);"


@pytest.fixture(params=["local", "spark"])
def make(spark, request):
    def build(text, facts=(), **how):
        e = Engine.from_source(spark, text, local_rows=0 if request.param == "spark" else 100_000, **how)
        e.add_facts(facts)
        return e

    return build


def edges(*pairs):
    return [("edge", p) for p in pairs]


def test_closure(make):
    e = make(TC, edges((1, 2), (2, 3), (3, 4), (2, 5))).run()
    assert e.rows("path") == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4)]
    assert e.relation("path").columns == ["c0", "c1"] and e.relation("path").count() == 8


def test_cycle_and_mutual(make):
    e = make(TC, edges((1, 2), (2, 1))).run()
    assert len(e.rows("path")) == 4
    e = make("relation number(int); relation even(int); relation odd(int); even(0) <-- number(0); odd(y) <-- even(x), let y = x + 1, number(y); even(y) <-- odd(x), let y = x + 1, number(y);", [("number", (i,)) for i in range(6)]).run()
    assert (e.rows("even"), e.rows("odd")) == ([(0,), (2,), (4,)], [(1,), (3,), (5,)])


def test_squared_distance(make):
    text = "relation point(int, int, int); relation d(int, int, int); d(a, b, (x - u) * (x - u) + (y - v) * (y - v)) <-- point(a, x, y), point(b, u, v), if a != b;"
    e = make(text, [("point", p) for p in [(1, 0, 0), (2, 3, 4), (3, 1, 1)]]).run()
    assert e.rows("d") == [(1, 2, 25), (1, 3, 2), (2, 1, 25), (2, 3, 13), (3, 1, 2), (3, 2, 13)]


def test_shortest_path(make):
    text = "relation edge(int, int, int); lattice sp(int, int, dual int); sp(x, y, w) <-- edge(x, y, w); sp(x, z, w + l) <-- edge(x, y, w), sp(y, z, ?l);"
    e = make(text, [("edge", p) for p in [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 1)]]).run()
    assert e.rows("sp") == [(0, 1, 3), (0, 2, 1), (0, 3, 4), (1, 3, 1), (2, 1, 2), (2, 3, 3)]
    assert len(e.explain("sp", (0, 1, 99))) == 2  # by the key alone


def test_symbols_and_namespaces(make):
    e = make("relation compiler(sym, sym); relation can(sym, sym); can(a, b) <-- compiler(a, b); can(a, c) <-- compiler(a, b), can(b, c);", [("compiler", p) for p in [("rust", "wasm"), ("wasm", "native"), ("native", "exe")]]).run()
    assert len(e.rows("can")) == 6
    text = "relation request(int); relation policy::grant(int); relation policy::deny(int); relation user::deny(int); relation allowed(int); allowed(x) <-- request(x), policy::grant(x), !policy::deny(x), !user::deny(x);"
    e = make(text, [("request", (i,)) for i in (1, 2, 3, 4)] + [("policy::grant", (i,)) for i in (1, 2, 3)] + [("policy::deny", (2,)), ("user::deny", (3,))]).run()
    assert e.rows("allowed") == [(1,)]


def test_stratified_negation(make):
    e = make("relation base(int); relation p(int); relation r(int); p(x) <-- base(x), if x > 0; r(x) <-- base(x), !p(x);", [("base", (i,)) for i in (-1, 0, 1, 2)]).run()
    assert e.rows("r") == [(-1,), (0,)]


def test_aggregates(make):
    text = "relation grade(int, int); relation stats(int, int, int, int); relation none(int, int); relation bad(int); stats(a, b, c, d) <-- agg a = min(x) in grade(_, x), agg b = max(x) in grade(_, x), agg c = sum(x) in grade(_, x), agg d = count() in grade(_, _); none(c, s) <-- agg c = count() in grade(99, _), agg s = sum(x) in grade(99, x); bad(m) <-- agg m = max(x) in grade(99, x);"
    e = make(text, [("grade", p) for p in [(1, 85), (2, 92), (3, 78), (4, 95), (5, 88)]]).run()
    assert (e.rows("stats"), e.rows("none"), e.rows("bad")) == ([(78, 95, 438, 5)], [(0, 0)], [])


def test_correlated_aggregates(make):
    text = "relation a(int); relation b(int, int); relation out(int, int, int); out(x, n, t) <-- a(x), agg n = count() in b(x, _), agg t = sum(y * x + n) in b(x, y);"
    e = make(text, [("a", (1,)), ("a", (2,)), ("a", (3,)), ("b", (1, 10)), ("b", (1, 20)), ("b", (2, 5))]).run()
    assert e.rows("out") == [(1, 2, 34), (2, 1, 11), (3, 0, 0)]


def test_matching(make):
    text = 'relation e(int, sym); relation loop(int); relation m(int); relation n(int); loop(x) <-- e(x, "a"), e(x, "b"); m(1) <-- e(_, 5); n(1) <-- !e(7, ?z), !e(y, "q");'
    e = make(text, [("e", (1, "a")), ("e", (1, "b")), ("e", (2, "a"))]).run()
    assert (e.rows("loop"), e.rows("m"), e.rows("n")) == ([(1,)], [], [(1,)])


def test_shadowing_and_multi_head(make):
    e = make("relation a(int); relation b(int); relation c(int, int); b(x), c(x, y) <-- a(x), let y = x, let x = x * 10;", [("a", (1,))]).run()
    assert (e.rows("b"), e.rows("c")) == ([(10,)], [(10, 1)])


def test_wrapping(make):
    big = 2**63 - 1
    e = make("relation a(int); relation b(int, int, int, int); b(x + 1, -(x + 1), x * 2, s) <-- a(x), agg s = sum(y + x - y) in a(y);", [("a", (big,))]).run()
    assert e.rows("b") == [(-(2**63), -(2**63), -2, big)]
    assert e.query("(x) <-- a(x)").rows() == [(big,)]


def test_division(make):
    e = make("relation a(int, int); relation b(int, int); b(x / y, x % y) <-- a(x, y), if y != 0 && x / y != 99;", [("a", p) for p in [(-7, 2), (7, -2), (5, 0)]]).run()
    assert e.rows("b") == [(-3, -1), (-3, 1)]


@pytest.mark.parametrize("facts", [[("a", (1, 0))], [("a", (-(2**63), -1))]])
@pytest.mark.parametrize("op", ["/", "%"])
def test_arithmetic_faults(make, facts, op):
    e = make(f"relation a(int, int); relation n(int); relation b(int); b(x {op} y) <-- a(x, y); ", facts)
    with pytest.raises(ExprFault):
        e.run()
    # the fault counts even if a later clause would drop the row, and not if an earlier one does
    with pytest.raises(EvalError):
        make(f"relation a(int, int); relation n(int); relation b(int); b(z) <-- a(x, y), let z = x {op} y, n(z);", facts).run()
    assert make(f"relation a(int, int); relation n(int); relation b(int); b(z) <-- a(x, y), n(x), let z = x {op} y;", facts).run().rows("b") == []


def test_static_faults_need_a_row(make):
    text = "relation a(int); relation b(int); b(y) <-- a(x);"
    assert make(text).run().rows("b") == []
    with pytest.raises(EvalError):
        make(text, [("a", (1,))]).run()
    with pytest.raises(EvalError):
        make("relation a(int); relation b(int); b(x) <-- a(x), if x == true;", [("a", (1,))]).run()
    with pytest.raises(EvalError):
        make("relation a(int);", [("a", (1,))]).query("(x) <-- if x > 0, a(x)")
    assert make("relation a(int); relation b(int); b(x) <-- a(x), if x + 1;", [("a", (1,))]).run().rows("b") == []


def test_facts_are_checked(make):
    e = make("relation node(sym, int); relation flag(bool); relation n(int);")
    e.add_fact("node", ("a", 1))
    for bad, error in [(("node", (1, 2)), ColumnType), (("node", ("a",)), Arity), (("other", (1,)), UnknownRelation), (("flag", (1,)), ColumnType), (("n", (True,)), ColumnType), (("n", (None,)), ColumnType), (("n", (2**63,)), ColumnType)]:
        with pytest.raises(error):
            e.add_fact(*bad)
    with pytest.raises(ColumnType):
        e.add_facts([("n", (1,)), ("n", ("x",))])
    assert e.rows("n") == [] and e.rows("unknown") == [] and e.relation("unknown").count() == 0


def test_rerun_is_additive(make):
    e = make("relation a(int); relation n(int); n(c) <-- agg c = count() in a(_);", [("a", (i,)) for i in range(3)]).run()
    e.add_fact("a", (9,))
    assert e.run().rows("n") == [(3,), (4,)]
    e = make(TC, edges((1, 2))).run()
    e.add_fact("path", (2, 7))
    assert e.run().rows("path") == [(1, 2), (1, 7), (2, 7)]


def test_iteration_limit(make):
    with pytest.raises(IterationLimit):
        make("relation a(int); a(x + 1) <-- a(x), if x < 50;", [("a", (0,))], max_iterations=3).run()


def test_queries(make):
    e = make(TC, edges((1, 2), (1, 3), (2, 3)))
    assert e.query("(x, z) <-- edge(x, y), edge(y, z)").justifications() == {(1, 3): [(("edge", (1, 2)), ("edge", (2, 3)))]}
    assert e.query("(x, y) <-- edge(x, y), if x == 1").rows() == [(1, 2), (1, 3)]
    r = e.query("(x) <-- edge(x, _)")
    assert r.rows() == [(1,), (2,)] and len(r.justifications()[(1,)]) == 2 and not r.truncated and len(r) == 2
    assert e.query("(x) <-- edge(x, _)", cap=3).truncated is False
    r = e.query("(x) <-- edge(x, _)", cap=1)
    assert r.truncated and len(r) == 1
    r = e.query("(x) <-- edge(x, _)", cap=0)
    assert r.truncated and r.is_empty()
    assert e.query("(x) <-- edge(x, 9)", cap=0).truncated is False
    assert e.query("(1 + 1, \"a\") <-- if true").rows() == [(2, "a")]
    assert e.evaluate_query(e.parse_query("(x) <-- edge(x, _), !edge(_, x)")).rows() == [(1,)]
    assert e.query('(x, n) <-- edge(x, _), agg n = count() in edge(x, _)').rows() == [(1, 2), (2, 1)]
    for text, error in [("(x) <-- node(x)", SchemaError), ("(z) <-- edge(x, y)", UnsafeError)]:
        with pytest.raises(error):
            e.query(text)
    assert [s.name for s in e.schema()] == ["edge", "path"] and e.check("(x) <-- edge(x, y)") == []


def test_big_integers_and_types(make):
    e = make("relation t(int, bool, sym);", [("t", (9007199254740993, True, "a")), ("t", (1, False, ""))])
    r = e.query("(a, b, c) <-- t(a, b, c)")
    assert r.rows() == [(1, False, ""), (9007199254740993, True, "a")]
    assert r.justifications()[(9007199254740993, True, "a")] == [(("t", (9007199254740993, True, "a")),)]
    assert r.provenance.count() == 2


def test_explain(make):
    e = make(TC, edges((1, 2), (2, 3))).run()
    assert [(d.rule, d.support) for d in e.explain("path", (1, 2))] == [(0, (("edge", (1, 2)),))]
    assert [(d.rule, d.support) for d in e.explain("path", (1, 3))] == [(1, (("edge", (1, 2)), ("path", (2, 3))))]
    assert e.explain("edge", (1, 2)) == [] and e.explain("path", (3, 1)) == []
    with pytest.raises(UnknownRelation):
        e.explain("nope", (1,))


def test_speculate(make):
    e = make(TC, edges((1, 2), (2, 3))).run()
    c = e.speculate(edges((3, 4)))
    assert c.rows("path") == [(1, 4), (2, 4), (3, 4)] and c.rows("edge") == [(3, 4)] and not c.is_empty()
    assert c.added("path").count() == 3 and {n for n, _ in c} == {"edge", "path"}
    assert e.rows("edge") == [(1, 2), (2, 3)] and e.speculate(edges((1, 2))).is_empty()
    with pytest.raises(UnknownRelation):
        e.speculate([("nope", (1,))])
    with pytest.raises(ColumnType):
        e.speculate([("edge", ("a", 1))])


def test_lattices(make):
    e = make("lattice best(int, int); lattice top(int); relation in(int, int); best(k, v) <-- in(k, v); top(v) <-- best(_, ?v);", [("in", p) for p in [(1, 5), (1, 7), (2, 3)]]).run()
    assert e.rows("best") == [(1, 7), (2, 3)] and e.rows("top") == [(7,)]
    c = e.speculate([("in", (2, 9))])
    assert c.rows("best") == [(2, 9)] and c.rows("top") == [(9,)]


def test_empty_program(make):
    assert make("").run().rows("x") == []
    assert make("lattice l(int); relation a(int); l(x) <-- a(x);").run().rows("l") == []


def joins(frame):
    import re

    return len(re.findall(r"Join", frame._jdf.queryExecution().optimizedPlan().toString()))


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_joins_are_linear_in_strata(spark):
    """Strata that join the one before with itself."""
    text = "relation r0(int, int); " + "".join(f"relation r{i}(int, int); r{i}(x, z) <-- r{i - 1}(x, y), r{i - 1}(y, z); " for i in range(1, 7))
    e = Engine.from_source(spark, text, local_rows=0)
    e.add_facts([("r0", (i, (i + 1) % 5)) for i in range(5)])
    e.run()
    assert joins(e.relation("r6")) <= 1
    assert e.rows("r6") == [(i, (i + 64) % 5) for i in range(5)]


def test_scans_are_constant_over_runs(spark):
    text = TC + "relation far(int); far(x) <-- path(x, y), if y > x + 3; relation leaf(int); leaf(y) <-- path(_, y), !edge(y, _); relation most(int); most(n) <-- agg n = count() in edge(_, _);"
    lone, grown = Engine.from_source(spark, text, local_rows=0), Engine.from_source(spark, text, local_rows=0)
    pairs = [(i, i + 1) for i in range(8)]
    counts, leaves, sizes = [], set(), set()
    for k in range(4):
        grown.add_dataframe("edge", spark.createDataFrame(pairs[2 * k : 2 * k + 2], "a long, b long"))
        grown.run()
        counts.append([scans(grown.relation(n)) for n in ("path", "far", "edge")])
        leaves |= {(2 * k + 2,)}
        sizes |= {(2 * k + 2,)}
    assert counts[1] == counts[2] == counts[3]
    lone.add_facts([("edge", p) for p in pairs])
    lone.run()
    for name in ("edge", "path", "far"):
        assert grown.rows(name) == lone.rows(name)
    # what was once derived by negation or an aggregate stays
    assert set(grown.rows("leaf")) == leaves and set(grown.rows("most")) == sizes


def test_runs_of_both_paths_agree(spark):
    """Facts in batches with a run behind each, of lattices, negation, aggregates and symbols."""
    text = """
        relation e(int, int, int); lattice sp(int, int, dual int); relation name(int, sym); relation named(sym, int); relation alone(sym); relation n(int);
        sp(x, y, Dual(w)) <-- e(x, y, w); sp(x, z, Dual(w + l)) <-- e(x, y, w), sp(y, z, ?Dual(l));
        named(s, l) <-- sp(x, _, ?Dual(l)), name(x, s); alone(s) <-- name(x, s), !e(x, _, _); n(c) <-- agg c = count() in sp(_, _, _);
    """
    batches = [[("e", (0, 1, 4)), ("name", (0, "a"))], [("e", (0, 2, 1)), ("e", (2, 1, 2)), ("name", (1, "b"))], [("e", (1, 3, 1)), ("sp", (3, 0, 7))], [], [("name", (2, "c"))]]
    found = []
    for rows in (100_000, 0):
        e, states = Engine.from_source(spark, text, local_rows=rows), []
        for facts in batches:
            e.add_facts(facts)
            extra = e.speculate([("e", (3, 4, 1))])
            e.run()
            states.append([e.rows(r) for r in e.relations] + [extra.rows(r) for r in e.relations])
        found.append(states)
    assert found[0] == found[1]


def test_both_paths_reject_alike(make):
    e = make('relation n(int, sym); relation b(bool); relation e(int, int); relation d(int); d(x / y) <-- e(x, y);', [("n", (1, "abc")), ("n", (2, "7")), ("b", (True,)), ("e", (6, 3))])
    for f in ("sum", "min", "max"):
        with pytest.raises(ColumnType):
            e.query(f"(x) <-- agg x = {f}(y) in n(_, y)")
    assert e.query("(x) <-- agg x = count(y) in n(_, y)").rows() == [(2,)] and e.query("(x) <-- agg x = sum(y) in b(y)").rows() == [(1,)]
    e.run()
    assert e.rows("d") == [(2,)]
    assert e.explain("d", ("x",)) == e.explain("d", (1, 2)) == e.explain("d", (None,)) == e.explain("d", (2**70,)) == []
    few = e.explain("d", (2,), cap=0)
    assert few == [] and few.truncated and len(e.explain("d", (2,))) == 1
    with pytest.raises(TypeMismatch):
        e.query("(x) <-- n(x, s), if x == s")
    with pytest.raises(Arithmetic):
        e.query("(x / 0) <-- n(x, _)")
    e.add_fact("e", (1, 0))
    with pytest.raises(Arithmetic):
        e.run()
    assert e.rows("d") == [(2,)]  # a run that fails changes nothing


def test_aggregates_over_the_same_rows_are_one_scan(spark, tmp_path):
    spark.range(20).selectExpr("id AS a", "id % 3 AS b").write.parquet(f"{tmp_path}/t")
    e = Engine.from_source(spark, "relation t(int, int); relation out(int, int, int, int); out(a, b, c, d) <-- agg a = count() in t(_, _), agg b = sum(x) in t(x, _), agg c = min(x + y) in t(x, y), agg d = max(b2) in t(_, b2); relation by(int, int, int); by(k, n, m) <-- t(_, k), agg n = count() in t(_, k), agg m = max(x) in t(x, k);", local_rows=0)
    e.add_dataframe("t", spark.read.parquet(f"{tmp_path}/t"), nulls="trust", distinct=False)
    e.run()
    assert scans(e.relation("out")) == 1 and e.rows("out") == [(20, 190, 0, 2)]
    assert scans(e.relation("by")) == 2 and e.rows("by") == [(0, 7, 18), (1, 7, 19), (2, 6, 17)]


def test_a_fault_costs_no_job_of_its_own(spark):
    e = Engine.from_source(spark, "relation t(int); relation out(int, int); out(x, 100 / x) <-- t(x), if x > 0, let y = 7 % x, if y > 0;", local_rows=0)
    e.add_dataframe("t", spark.range(20).toDF("a"), nulls="trust", distinct=False)
    spark.sparkContext.setJobGroup("faults", "faults")
    e.run()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("faults")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # one query: the map stage of its shuffle, and the write
    assert len(e.rows("out")) == 17


def test_free_deletes_what_was_stored(spark):
    e = Engine.from_source(spark, TC, local_rows=0)
    e.add_facts(edges((1, 2), (2, 3)))
    e.run()
    files = [p.removeprefix("file://").removeprefix("file:") for p in e.relation("path").inputFiles()]
    assert files and all(map(os.path.exists, files))
    e.free()
    assert e.rows("path") == [] and not any(map(os.path.exists, files))


def test_a_store_of_facts(make):
    from lakelog.store import FactStore

    def ask(store: FactStore, text):
        q = store.parse_query(text)
        store.check(q)
        return store.eval(q, 10)

    rows, why = ask(make(TC, edges((1, 2), (1, 3))), "(x) <-- edge(x, _)")
    assert [tuple(r) for r in rows.collect()] == [(1,)] and len(why.first().justifications) == 2
