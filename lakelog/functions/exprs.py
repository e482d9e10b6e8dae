"""Expressions as columns: a value, and where they can fail a flag.

Integers wrap at 64 bits.  Division and remainder truncate, and fail by zero and for the
least integer by -1.  Faults are flags and never exceptions of the plan, because the
optimizer may move an expression to rows that the program doesn't let it see.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelog.plans.ir import BOOL, INT, SYM, Binary, Expr, Lit, Unary, Var

SPARK_TYPES = {INT: T.LongType(), BOOL: T.BooleanType(), SYM: T.StringType()}
_MIN = -(2**63)
_mode = threading.RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans built inside wrap on overflow; Spark keeps the mode in the plan.  The setting is
    the session's, so engines of several threads take turns."""
    with _mode:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


def literal(value: int | bool | str) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)


def _either(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a | b


def compile_expr(e: Expr, env: dict[str, Column]) -> tuple[Column, Column | None]:
    """(value, fault) of a well-typed expression; the value is null where the fault holds."""
    if isinstance(e, Lit):
        return literal(e.value), None
    if isinstance(e, Var):
        return env[e.name], None
    if isinstance(e, Unary):
        value, fault = compile_expr(e.of, env)
        return (-value if e.op == "-" else ~value), fault
    a, fa = compile_expr(e.left, env)
    b, fb = compile_expr(e.right, env)
    if e.op in ("&&", "||"):
        # the right side counts only where the left one doesn't decide
        decided = ~a if e.op == "&&" else a
        fault = _either(fa, None if fb is None else ~F.coalesce(decided, F.lit(True)) & fb)
        return (a & b if e.op == "&&" else a | b), fault
    if e.op in ("/", "%"):
        own = (b == 0) | ((a == F.lit(_MIN)) & (b == -1))
        safe = F.when(~own, b)
        value = F.call_function("div", a, safe) if e.op == "/" else a % safe
        return value, _either(_either(fa, fb), F.coalesce(own, F.lit(False)))
    ops = {"+": a + b, "-": a - b, "*": a * b} if e.op in "+-*" else {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return ops[e.op], _either(fa, fb)
