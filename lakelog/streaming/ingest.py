"""Micro-batches of a stream as batches of facts.

Each batch is asserted and the rules run again from what is new (see ``Engine.run``), so the
work and the plan of a batch don't grow with the number of batches before.

With a checkpoint, the facts of each batch are kept beside it, in a folder by the batch's
number: a query that starts again with a new engine asserts them before it goes on, and a
batch that is delivered a second time replaces its folder and adds nothing.  A sink gets every
batch's consequences, and is to be idempotent by the batch's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lakelog.engine import Engine
from lakelog.operators.materialize import new_folder


def run_on_stream(engine: Engine, relation: str, stream: DataFrame, sink: Callable[[Engine, int], None] | None = None, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` is passed on, e.g. ``availableNow=True``."""
    spark = engine.spark
    kept = f"{checkpoint.rstrip('/')}-facts-{relation.replace(':', '_')}" if checkpoint else None
    schema = stream.schema
    if kept:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(kept)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            engine.add_dataframe(relation, spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(kept), nulls="drop")
            engine.run()

    def batch(rows: DataFrame, number: int) -> None:
        # written once: what is asserted is read from there, not from the stream again
        path = f"{kept}/batch-{number}" if kept else new_folder(spark, "batch")
        rows.write.mode("overwrite").parquet(path)
        engine.add_dataframe(relation, spark.read.schema(schema).parquet(path), nulls="drop")
        engine.run()
        if sink:
            sink(engine, number)

    writer = stream.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
