"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.operators.materialize import remove, shared_dir

__all__ = ["new_path", "persist", "remove", "shared_dir", "small"]

#: Bytes that are broadcast at most, where their number depends on the data.
BROADCAST_BYTES = 32 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read, never a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int, size: Column | None = None, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, and at most ``most_bytes`` by the ``size`` of
    a row; reads no more rows than that."""
    size = F.lit(0) if size is None else size
    found = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found.n <= most_rows and found.bytes <= most_bytes
