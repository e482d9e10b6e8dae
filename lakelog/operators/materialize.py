"""Tables written once to the cluster's shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelog.errors import Arithmetic, ExprFault, RuntimeFault, StorageError, TypeMismatch, UnboundVar

FAULT = "__fault"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.  Where it is unset, a session in
    one process (tests) gets a temporary folder; on a cluster it is an error, because a
    machine's own disk can't be read by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            path = "file://" + tempfile.mkdtemp(prefix="lakelog-")
        else:
            raise StorageError("spark.checkpoint.dir is unset: the cluster's shared folder is needed")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def raise_fault(found: str | None) -> None:
    """``found``: a fault's class and message."""
    if found:
        kind, _, message = found.partition(": ")
        raise {c.__name__: c for c in (UnboundVar, TypeMismatch, Arithmetic, RuntimeFault)}.get(kind, ExprFault)(message)


class Stored:
    """A relation as Parquet folders: adding rows rewrites nothing, and reading it is one scan
    without lineage.  Beyond ``MOST`` folders they are written together."""

    MOST = 24

    def __init__(self, spark: SparkSession, schema: T.StructType, paths: tuple[str, ...] = ()):
        self.spark, self.schema, self.paths = spark, schema, paths

    def add(self, rows: DataFrame, faults: list[tuple[ExprFault, DataFrame]] = ()) -> tuple[Stored, DataFrame, int]:
        """With the rows added; the rows as read back; how many they are.  One job writes rows
        and faults and counts them; a fault is raised."""
        path = new_folder(self.spark, "rows")
        rows = rows.select(*self.schema.names)
        counts = [F.count(F.lit(1)).alias("n")]
        if faults:
            rows = rows.withColumn(FAULT, F.lit(None).cast("string"))
            for fault, bad in faults:
                found = bad.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(f"{type(fault).__name__}: {fault}").alias(FAULT))
                rows = rows.unionByName(found)
            counts.append(F.max(FAULT).alias("fault"))
        seen = Observation(f"stored-{uuid.uuid4().hex}")
        rows.observe(seen, *counts).write.parquet(path)
        if faults and seen.get["fault"]:
            remove(self.spark, path)
            raise_fault(seen.get["fault"])
        n = seen.get["n"]
        added = self.spark.read.schema(self.schema).parquet(path)
        if n and len(self.paths) >= self.MOST:
            whole = new_folder(self.spark, "rows")
            self.spark.read.schema(self.schema).parquet(*self.paths).write.parquet(whole)
            return Stored(self.spark, self.schema, (whole, path)), added, n
        return (Stored(self.spark, self.schema, (*self.paths, path)) if n else self), added, n

    def read(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def remove(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
