"""Line dedup with levelled sorted runs of line hashes.

The hashes of seen lines live in runs: tables bucketed and sorted by hash, in the shared
folder.  A batch of documents is reduced to its distinct line hashes, merge-anti-joined
with every run (both sides bucketed alike, so that no run is shuffled again), and what is
new becomes a run of level 0.  ``fanout`` runs of one level are compacted into one run of
the next, so that a batch meets at most ``(fanout - 1) * log(batches)`` runs.  Runs given by
the caller (``runs``) are added to and stay, for the corpora that follow; what is found to
be repeated then includes lines of the corpora before.

The first occurrence of a line by (batch, doc_id, place in the text) stays; batches are
ranges of doc_id, so the order is that of doc_id.  Lines are compared without outer
blanks, by 128 bits of hash; lines under ``min_chars`` characters are always kept.

Defined cases: a null text stays null, an empty one empty; a document whose lines were
all seen before has an empty text left; rows that repeat both doc_id and text are one
document that is written as often as it came; rows that share a doc_id but differ in
text are separate documents; null doc_ids come first; an empty table gives an empty
result; further columns are never read by ``line_dedup`` and are passed by
``drop_seen_lines``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.storage import new_path, persist, remove, small

MIN_CHARS = 16
BATCHES = 4
FANOUT = 2
#: Documents with lines to drop that are broadcast, if their bytes are few as well; beyond it
#: the texts are shuffled to them.
BROADCAST_DOCUMENTS = 500_000
HASH = ["h1", "h2"]


class LineRuns:
    """The runs of one corpus.  ``add`` takes batches of (h1, h2, doc_id, th, pos)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        # a bucket is one file, sorted: scans needn't sort it again
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"lakelog_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        remove(self.spark, run[1])

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """Keep of ``batch`` the first place of each line that no run has."""
        fresh = batch.groupBy(*HASH).agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"))
        for run in self.tables():
            fresh = fresh.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        self._put(0, self._write(fresh.select(*HASH, "first.*")))

    def _put(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._put(level + 1, self._write(merged.repartition(self.buckets, *HASH)))
            for run in old:
                self._drop(run)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2 of each line that takes part."""
    line = F.trim(F.col("line"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.filter(F.length(line) >= min_chars)
    return rows.select("doc_id", "th", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(0x5EED), line).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, th, drops): places of the lines that occurred before, of each document with any."""
    spark = docs.sparkSession
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (ends.lo, ends.hi) if ends.lo is not None else (0, 0)
    # the steps between the bounds are exact for any 64-bit ids
    bounds = [lo + (hi - lo + 1) * k // batches for k in range(1, batches)]
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + F.when(F.col("doc_id") >= F.lit(bound), 1).otherwise(0)
    lines = persist(_lines(docs, min_chars).withColumn("batch", batch), "lines", partition_by="batch")
    own = runs or LineRuns(spark, fanout)
    for k in range(batches):
        own.add(lines.filter(F.col("batch") == k))
    # each run by its buckets: runs aren't shuffled, and the lines once for all of them
    late = []
    for run in own.tables():
        first = run.select(*HASH, F.struct(F.col("doc_id"), F.col("th"), F.col("pos")).alias("first"))
        late.append(lines.join(first.hint("merge"), HASH).filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first"))).select("doc_id", "th", "pos"))
    drops = persist(reduce(DataFrame.union, late).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drops")), "drops")
    if runs is None:
        own.close()
    return drops


def drop_seen_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, counts: bool = False, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; with ``counts``, also n_lines and n_dropped."""
    narrow = docs.select("doc_id", "text")
    drops = dropped_lines(narrow, min_chars, batches, fanout, runs)
    own_id, own_hash, gone = drops["doc_id"], drops["th"], drops["drops"]
    drops = F.broadcast(drops) if small(drops, BROADCAST_DOCUMENTS, F.size("drops") * 4 + 40) else drops
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(own_id) & (F.xxhash64(docs["text"]) == own_hash), "left")
    lines = F.split(docs["text"], "\n")
    # a long text may lose many lines: which ones stay is found by one hash set, and the text is cut once
    kept = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
    rest = F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept(x), lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(gone.isNull(), docs["text"]).otherwise(rest)
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if counts:
        n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.size(lines))
        n_dropped = F.when(gone.isNull(), 0).otherwise(F.size(gone))
        out += [n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped")]
    return joined.select(*out)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text without repeated lines, n_lines and n_dropped of every row of ``docs``."""
    return drop_seen_lines(docs.select("doc_id", "text"), min_chars, batches, fanout, counts=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document without the lines that came before."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (
  SELECT *, length(trim(line)) < {MIN_CHARS} OR row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) = 1 AS keep
  FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped
FROM k GROUP BY doc_id
"""
