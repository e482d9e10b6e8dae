"""Order-preserving packing of documents into windows of ``capacity`` tokens.

Documents in the order of doc_id are one sequence of sentences.  Windows are runs of whole
sentences; a cut costs nothing at the end of a document, ``cut_sentence`` inside one, and
``cut_hard`` inside a sentence that is longer than a window (such a sentence is divided
into pieces of ``capacity``, nothing is lost).  The cuts chosen have the least sum of
padding (empty places, in tokens) and cut penalties: with S the running token count,

    f(j) = capacity - S(j) + penalty(j) + min { f(i) + S(i) : S(j) - S(i) <= capacity }

where the minimum slides with a monotone queue, so that n sentences take O(n) steps.

The sequence is divided into shards of ``docs_per_shard`` consecutive documents, by their rank
in the order of doc_id (range partitions with running counts), whatever the ids are.  Shards
are packed independently and in parallel: their number grows with the data, their size
doesn't.  The cost is least within each shard; no window crosses a shard's end, which costs
one part-filled window a shard at most.  Only sentence lengths are shuffled, never texts.

Defined cases: a null or empty text has no tokens and is in no window; rows with a null
doc_id come first; rows that repeat a doc_id follow
each other and stay separate spans; of equal costs the cut with the fuller window counts;
an empty table gives no windows; only doc_id and text are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelog.llm.storage import persist
from lakelog.llm.text import Words, chunks

CAPACITY = 2048
CUT_SENTENCE = 64.0
CUT_HARD = 512.0
DOCS_PER_SHARD = 4096

WINDOWS = "shard long, window int, n_tokens int, padding int, spans array<struct<doc_id:long,from_token:int,to_token:int>>"


def sentence_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, lengths): the tokens of each sentence, of texts that have any.  A sentence
    ends with a line, or with . ! or ? before white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column(1))
            ends = words.sentence_ends()
            at = np.flatnonzero(ends)
            lengths = np.diff(np.concatenate([[-1], at]))
            first = np.searchsorted(at, words.first)
            out = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(lengths, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "lengths"]).filter(pa.array(np.diff(first) > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lengths array<int>")


def plan(lengths: list[int], penalties: list[float], capacity: int) -> list[int]:
    """The ends of the windows that cost least; every length is at most ``capacity``."""
    n = len(lengths)
    total, cost, back = [0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    s = 0
    for j in range(1, n + 1):
        s += lengths[j - 1]
        total[j] = s
        while s - total[queue[0][1]] > capacity:
            queue.popleft()
        least, i = queue[0]
        f = capacity - s + penalties[j - 1] + least
        cost[j], back[j] = f, i
        value = f + s
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    ends, j = [], n
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def pieces(rows: list[tuple], capacity: int, cut_sentence: float, cut_hard: float) -> tuple[list[int], list[float], list[int]]:
    """Lengths, penalties of a cut behind them, and indices of the rows, of all pieces of the sequence."""
    lengths: list[int] = []
    penalties: list[float] = []
    of: list[int] = []
    for k, row in enumerate(rows):
        for n in row:
            while n > capacity:
                lengths.append(capacity)
                penalties.append(cut_hard)
                of.append(k)
                n -= capacity
            lengths.append(n)
            penalties.append(cut_sentence)
            of.append(k)
        penalties[-1] = 0.0
    return lengths, penalties, of


def ranked(sized: DataFrame) -> DataFrame:
    """(doc_id, lengths, rank): the place of each row in the order of doc_id, nulls first."""
    tie = F.xxhash64("lengths")
    ordered = persist(sized, "lengths").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "lengths")
    # the id's upper bits are the partition, its lower 33 bits the place in it
    placed = persist(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.select("doc_id", "lengths", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("doc_id", "lengths", (F.col("before") + F.col("place")).alias("rank"))


def pack(docs: DataFrame, capacity: int = CAPACITY, cut_sentence: float = CUT_SENTENCE, cut_hard: float = CUT_HARD, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Windows in order: n_tokens, padding, and the spans (doc_id, from_token, to_token) that fill them."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [x.tolist() for x in pdf["lengths"]]
        null = pdf["doc_id"].isna().to_numpy()
        ids = [None if z else int(x) for x, z in zip(pdf["doc_id"], null)]
        order = sorted(range(len(rows)), key=lambda k: (ids[k] is not None, ids[k] or 0, rows[k]))
        rows, ids = [rows[k] for k in order], [ids[k] for k in order]
        lengths, penalties, of = pieces(rows, capacity, cut_sentence, cut_hard)
        out, begin, used, at = [], 0, 0, -1
        for w, end in enumerate(plan(lengths, penalties, capacity)):
            spans: list[list] = []
            for k in range(begin, end):
                if of[k] != at:
                    at, used = of[k], 0
                    spans.append([ids[at], 0, 0])
                elif not spans:
                    spans.append([ids[at], used, used])
                used += lengths[k]
                spans[-1][2] = used
            n = sum(b - a for _, a, b in spans)
            out.append((pdf["shard"].iloc[0], w, n, capacity - n, [{"doc_id": d, "from_token": a, "to_token": b} for d, a, b in spans]))
            begin = end
        return pd.DataFrame(out, columns=["shard", "window", "n_tokens", "padding", "spans"])

    sized = ranked(sentence_lengths(docs)).select("doc_id", "lengths", F.expr(f"rank div {docs_per_shard}L").alias("shard"))
    return sized.groupBy("shard").applyInPandas(shard, WINDOWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
