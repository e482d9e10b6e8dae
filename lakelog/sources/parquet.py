"""Parquet tables as facts, lowered to the three types where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelog.errors import ArityDrift
from lakelog.sources.source import FactSource, PredicateDescriptor, content_digest, fingerprint


def lower(column: str, kind: T.DataType, scale: int = 0) -> Column:
    """A column as int, bool or symbol: integers widen, dates count days and timestamps
    microseconds, reals and decimals are scaled by 10**scale and rounded."""
    c = F.col(column)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return c
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(c * F.lit(10**scale)).cast("bigint")
    raise TypeError(f"{column}: {kind.simpleString()} has to be lowered to columns or a side relation")


def facts(df: DataFrame, *columns: str, scale: dict[str, int] | None = None) -> DataFrame:
    """The named columns, lowered; the scan reads no others."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[lower(c, kinds[c], (scale or {}).get(c, 0)).alias(c) for c in columns])


def elements(df: DataFrame, key: str, column: str, scale: int = 0) -> DataFrame:
    """(key, index, element) of an array column: how sequences become a side relation."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(lower(key, kinds[key]).alias(key), F.posexplode(column).alias("index", "element"))
    return rows.select(key, F.col("index").cast("bigint").alias("index"), lower("element", kinds[column].elementType, scale).alias("element"))


def table_fingerprint(name: str, df: DataFrame, columns: list[str]) -> str:
    """A digest of the columns that a predicate is read from, with their own names and types:
    it sees renamed columns and other changes that lowering hides."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return fingerprint(name, tuple(f"{c} {kinds[c]}" for c in columns))


class ParquetSource(FactSource):
    """Predicates over Parquet tables: name -> (path, columns, doc).  ``declared`` has the
    descriptors that the tables are expected to have; a table that has drifted from its own
    fails before anything is read from it.  Others are described as they are found."""

    def __init__(self, spark: SparkSession, tables: dict[str, tuple[str, list[str], str]], scale: dict[str, int] | None = None, declared: list[PredicateDescriptor] = ()):
        self._frames, self._descriptors = {}, []
        expected = {d.name: d for d in declared}
        kinds = {"bigint": "int", "boolean": "bool", "string": "sym"}
        for i, (name, (path, columns, doc)) in enumerate(tables.items(), 1):
            df = spark.read.parquet(path)
            lost = [c for c in columns if c not in df.columns]
            if lost:
                raise ArityDrift(f"{name}: {path} has no column {lost[0]}")
            frame = facts(df, *columns, scale=scale)
            types, digest = tuple(kinds[f.dataType.simpleString()] for f in frame.schema.fields), table_fingerprint(name, df, columns)
            found = expected.get(name) or PredicateDescriptor(i, name, types, doc, digest)
            found.validate(types, digest)
            self._frames[name] = frame
            self._descriptors.append(found)

    def schema(self) -> list[PredicateDescriptor]:
        return list(self._descriptors)

    def content_id(self) -> str:
        """A digest of the facts themselves: equal for equal facts in other files."""
        return content_digest(self._frames)

    def to_dataframe(self, spark: SparkSession, predicate: PredicateDescriptor) -> DataFrame:
        return self._frames[predicate.name]
