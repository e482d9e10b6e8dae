"""Random programs: the Python path against Spark's."""

import random

import pytest

from lakelog import Engine
from lakelog.errors import LakelogError
from lakelog.plans.ir import Binary, Lit, Unary, Var
from lakelog.operators.local import evaluate
from lakelog.errors import ExprFault
from lakelog.functions.exprs import compile_expr, wrapping


def term(r, names):
    return r.choice([*names, *names, str(r.randint(0, 3)), "_"])


def expr(r, names):
    a, b = (r.choice([*names, str(r.randint(0, 4))]) for _ in range(2))
    return f"({a} {r.choice(['+', '-', '*', '/', '%'])} {b})" if r.random() < 0.5 else a


def program(r):
    arity = {f"r{i}": r.randint(1, 2) for i in range(r.randint(3, 5))}
    names = list(arity)
    text = "".join(f"relation {n}({', '.join(['int'] * k)}); " for n, k in arity.items())
    for i, head in enumerate(names[1:], 1):
        for _ in range(r.randint(1, 2)):
            clauses, bound = [], []
            for _ in range(r.randint(1, 2)):
                name = r.choice(names[: i + 1])
                args = [term(r, ["x", "y", "z"]) for _ in range(arity[name])]
                bound += [a for a in args if a in "xyz"]
                clauses.append(f"{name}({', '.join(args)})")
            if not bound:
                continue
            kind = r.random()
            lower = r.choice(names[:i])
            if kind < 0.2:
                clauses.append(f"!{lower}({', '.join(term(r, bound) for _ in range(arity[lower]))})")
            elif kind < 0.4:
                clauses.append(f"agg n = {r.choice(['count()', 'sum(w)', 'min(w + ' + bound[0] + ')', 'max(w)'])} in {lower}({', '.join((['w'] + [r.choice(bound)])[: arity[lower]])})")
                bound.append("n")
            elif kind < 0.6:
                clauses.append(f"let v = {expr(r, bound)}")
                bound.append("v")
            clauses.append(f"if {r.choice(bound)} {r.choice(['<', '<=', '!=', '=='])} {r.randint(0, 9)}")
            text += f"{head}({', '.join(r.choice(bound) if r.random() < 0.8 else str(r.randint(0, 3)) for _ in range(arity[head]))}) <-- {', '.join(clauses)}; "
    facts = [(n, tuple(r.randint(0, 3) for _ in range(arity[n]))) for n in names[:2] for _ in range(r.randint(0, 5))]
    return text, facts, names


@pytest.mark.parametrize("seed", range(12))
def test_programs(spark, seed):
    text, facts, names = program(random.Random(seed))
    found = []
    for rows in (100_000, 0):
        try:
            e = Engine.from_source(spark, text, local_rows=rows, max_iterations=30)
            e.add_facts(facts)
            e.run()
            found.append({n: e.rows(n) for n in names})
        except LakelogError as error:
            found.append(type(error).__mro__[1].__name__)
    assert found[0] == found[1], text


def tree(r, depth, kind):
    if depth == 0 or r.random() < 0.2:
        return (Lit(r.randint(-4, 4)) if r.random() < 0.6 else Var(r.choice("ab"))) if kind == "int" else Lit(r.random() < 0.5)
    if kind == "int":
        return Unary("-", tree(r, depth - 1, "int")) if r.random() < 0.2 else Binary(r.choice("+-*/%"), tree(r, depth - 1, "int"), tree(r, depth - 1, "int"))
    if r.random() < 0.2:
        return Unary("!", tree(r, depth - 1, "bool"))
    if r.random() < 0.5:
        return Binary(r.choice(["&&", "||"]), tree(r, depth - 1, "bool"), tree(r, depth - 1, "bool"))
    return Binary(r.choice(["==", "!=", "<", "<=", ">", ">="]), tree(r, depth - 1, "int"), tree(r, depth - 1, "int"))


def test_expressions(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    values = [-(2**63), -3, -1, 0, 1, 2, 2**63 - 1]
    rows = [(a, b) for a in values for b in values]
    with wrapping(spark):
        df = spark.createDataFrame(rows, "a long, b long")
        trees = [tree(r, 4, r.choice(["int", "bool"])) for _ in range(60)]
        columns = []
        for i, t in enumerate(trees):
            value, fault = compile_expr(t, {"a": F.col("a"), "b": F.col("b")})
            columns += [value.alias(f"v{i}"), (F.lit(False) if fault is None else fault).alias(f"f{i}")]
        got = df.select("a", "b", *columns).collect()
    for row in got:
        for i, t in enumerate(trees):
            try:
                want = evaluate(t, {"a": row.a, "b": row.b})
            except ExprFault:
                assert row[f"f{i}"] is True, (t, row.a, row.b)
            else:
                assert row[f"f{i}"] is False and row[f"v{i}"] == want, (t, row.a, row.b)
