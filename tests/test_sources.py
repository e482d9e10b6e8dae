import pytest

from lakelog import Engine
from lakelog.errors import Arity, ArityDrift, ColumnType, ColumnTypeDrift, FingerprintDrift, SchemaError
from lakelog.sources.parquet import ParquetSource, elements, facts
from lakelog.sources.source import PredicateDescriptor, RowsSource
from lakelog.streaming.ingest import run_on_stream

SYMBOL = PredicateDescriptor(1, "parser.symbol", ("sym", "int"), "symbols and where they are", "07" * 32)


def test_drift_in_order():
    SYMBOL.validate(("sym", "int"), "07" * 32)
    with pytest.raises(ArityDrift):
        SYMBOL.validate(("sym",), "09" * 32)
    with pytest.raises(ColumnTypeDrift):
        SYMBOL.validate(("int", "int"), "09" * 32)
    with pytest.raises(FingerprintDrift):
        SYMBOL.validate(("sym", "int"), "09" * 32)
    assert SYMBOL.arity == 2


def test_rows_source(spark):
    d = PredicateDescriptor(1, "symbol", ("sym", "int"), "")
    source = RowsSource([d], [(1, ("alpha", 10)), (1, ("beta", 20))])
    e = Engine.from_source(spark, "relation symbol(sym, int); relation big(sym); big(s) <-- symbol(s, n), if n > 10;")
    assert e.ingest(source) == source.content_id()
    assert e.run().rows("big") == [("beta",)] and e.rows("symbol") == [("alpha", 10), ("beta", 20)]
    assert RowsSource([d], [(1, ("alpha", 11))]).content_id() != source.content_id()
    with pytest.raises(ColumnTypeDrift):
        Engine.from_source(spark, "relation symbol(int, int);").ingest(source)
    with pytest.raises(SchemaError):
        Engine.from_source(spark, "relation other(int);").ingest(source)


def test_parquet(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.sql("SELECT 1 AS a, 'x' AS b, 12.345D AS c, DATE'1970-01-03' AS d, true AS e, array(1.5, 2.5) AS f, TIMESTAMP'1970-01-01 00:00:01' AS g").write.parquet(path)
    df = spark.read.parquet(path)
    assert tuple(facts(df, "a", "b", "c", "d", "e", "g", scale={"c": 2}).first()) == (1, "x", 1235, 2, True, 1_000_000)
    assert [tuple(r) for r in elements(df, "a", "f", 1).collect()] == [(1, 0, 15), (1, 1, 25)]
    with pytest.raises(TypeError):
        facts(df, "f")
    source = ParquetSource(spark, {"t": (path, ["a", "b"], "rows")})
    e = Engine.from_source(spark, "relation t(int, sym);")
    assert e.ingest(source) == ParquetSource(spark, {"t": (path, ["a", "b"], "rows")}).content_id()
    assert e.rows("t") == [(1, "x")] and not e.is_local


def test_dataframes(spark):
    e = Engine.from_source(spark, "relation t(int, sym);")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    with pytest.raises(ColumnType):
        e.add_dataframe("t", rows)
    with pytest.raises(Arity):
        e.add_dataframe("t", rows.select("k"))
    with pytest.raises(ColumnType):
        e.add_dataframe("t", rows.select("v", "k"))
    e.add_fact("t", (2, "z"))
    e.add_dataframe("t", rows, nulls="drop")
    e.add_fact("t", (3, "y"))
    assert e.rows("t") == [(1, "a"), (2, "z"), (3, "y")]


def test_plans_are_pruned_and_pushed_down(spark, tmp_path):
    path = f"{tmp_path}/wide.parquet"
    spark.range(100).selectExpr("id AS a", "id % 7 AS b", "id * 2 AS c", "'x' AS d").write.parquet(path)
    e = Engine.from_source(spark, "relation t(int, int, int, sym); relation out(int); out(a) <-- t(a, 3, _, _);", local_rows=0)
    e.add_dataframe("t", spark.read.parquet(path), nulls="trust", distinct=False)
    plan = e.run().relation("out")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(b,3)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_stream(spark, tmp_path):
    for k, pairs in enumerate([[(1, 2)], [(2, 3), (3, 4)]]):
        spark.createDataFrame(pairs, "a long, b long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = Engine.from_source(spark, "relation edge(int, int); relation hop(int, int); hop(x, z) <-- edge(x, y), edge(y, z);", local_rows=0)
    seen = []
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run_on_stream(e, "edge", stream, lambda engine, n: seen.append(n), checkpoint=f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination()
    assert len(seen) >= 2 and e.rows("hop") == [(1, 3), (2, 4)]
    # a new engine goes on where the one before ended
    spark.createDataFrame([(4, 5)], "a long, b long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = Engine.from_source(spark, "relation edge(int, int); relation hop(int, int); hop(x, z) <-- edge(x, y), edge(y, z);", local_rows=0)
    q = run_on_stream(e, "edge", stream, checkpoint=f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination()
    assert e.rows("hop") == [(1, 3), (2, 4), (3, 5)]


def test_content_ids_are_of_the_facts(spark, tmp_path):
    df = spark.range(50).selectExpr("id AS a", "concat('x', id) AS b")
    df.repartition(3).write.parquet(f"{tmp_path}/one")
    df.coalesce(1).write.parquet(f"{tmp_path}/two")
    df.filter("a > 0").write.parquet(f"{tmp_path}/less")
    one, two, less = (ParquetSource(spark, {"t": (f"{tmp_path}/{x}", ["a", "b"], "rows")}).content_id() for x in ("one", "two", "less"))
    assert one == two != less


def test_drift_of_tables_and_batches(spark, tmp_path):
    spark.range(3).selectExpr("id AS a", "id AS b").write.parquet(f"{tmp_path}/one")
    spark.range(3).selectExpr("id AS a", "id AS c").write.parquet(f"{tmp_path}/renamed")
    one = ParquetSource(spark, {"t": (f"{tmp_path}/one", ["a", "b"], "rows")})
    with pytest.raises(FingerprintDrift):
        ParquetSource(spark, {"t": (f"{tmp_path}/renamed", ["a", "c"], "rows")}, declared=one.schema())
    with pytest.raises(ArityDrift):
        ParquetSource(spark, {"t": (f"{tmp_path}/renamed", ["a", "b"], "rows")})
    e = Engine.from_source(spark, "relation t(int, int);")
    e.ingest(one)
    with pytest.raises(FingerprintDrift):  # the first batch's fingerprint holds for later ones
        e.ingest(ParquetSource(spark, {"t": (f"{tmp_path}/renamed", ["a", "c"], "rows")}))
    assert e.relation("t").count() == 3
