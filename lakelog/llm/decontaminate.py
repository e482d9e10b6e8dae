"""Benchmark decontamination by spaced seeds.

A seed is a window of tokens seen through a fixed mask that ignores some positions; its
hash covers the other ones.  Hashes of all windows of the benchmark and of the training
texts are joined; around each hit the two texts are laid on the hit's diagonal, and the
pair is reported if some window of ``min(window, benchmark tokens)`` tokens agrees in at
least ``share`` of its positions.  Substituted words between the mask's positions, and
other ones within the tolerated share, don't hide an overlap.

One scan of the texts: seeds are looked up in a bitmap of the benchmark's seeds (fixed
size, two probes; it only saves work, the join decides), and texts leave the scan only as
short regions around possible hits.  Everything behind that is a Spark join of small rows.

Defined cases: null or empty texts and benchmark items have no tokens and never match;
items or texts with fewer tokens than a mask spans can't be hit by it: items of up to 5
tokens never match, as too common to tell; those of 6 and 7 have masks of their own, so that
one substitution at any place is found; rows with a null doc_id or item_id are left out of the report, and so kept by
``drop_leaks``; repeated rows give one pair; of equal best windows the first counts; empty
tables give an empty result; only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.storage import persist, small
from lakelog.llm.text import SQL_SPLIT, U, Words, chunks, longs, mix

#: Weight 5 of span 6, 8 and 9 (1: the position counts).
MASKS = ("110111", "11010011", "101100101")
#: For items of 6 and 7 tokens: every mask of span 6 with one position left out.
SHORT_MASKS = ("011111", "101111", "111011", "111101", "111110")
SHORT = (6, 7)
WINDOW = 12
SHARE = 0.8
BITS = 23
#: Seeds of a benchmark that are broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 500_000

_SEEDS = "item_id long, ipos int, seed long, mask int"
_REGIONS = "doc_id long, start int, tokens array<long>, hits array<struct<pos:int,seed:long>>"


def _seeds(words: Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (into the words) of the mask's windows, and their hashes."""
    span = len(mask)
    count = np.maximum(np.diff(words.first) - span + 1, 0)
    first = np.cumsum(count) - count
    at = np.repeat(words.first[:-1] - first, count) + np.arange(count.sum())
    h = np.full(len(at), number + 1, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h = h * U(0x9E3779B97F4A7C15) + words.hashes[at + j]
    return at, mix(h)


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)


def benchmark_seeds(benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(item_id, ipos, seed, mask) of every window of every item, for every mask; ``SHORT_MASKS``
    follow the other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            of = words.text_of()
            short = np.isin(np.diff(words.first), SHORT)
            for k, mask in enumerate((*masks, *SHORT_MASKS)):
                at, h = _seeds(words, mask, k)
                if k >= len(masks):
                    at, h = at[short[of[at]]], h[short[of[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[at]], pa.int64()), pa.array(at - words.first[of[at]], pa.int32()), longs(h), pa.array(np.full(len(at), k), pa.int32())], ["item_id", "ipos", "seed", "mask"])

    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL")
    return items.mapInArrow(run, _SEEDS)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The seeds' bitmap; at most 2**(bits - 6) rows reach the driver, however many seeds."""
    p1 = F.shiftrightunsigned("seed", 64 - bits)
    p2 = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    probes = seeds.select(F.explode(F.array(p1, p2)).alias("p"))
    words = probes.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _regions(docs: DataFrame, bitmap, masks: dict[int, str], bits: int, margin: int) -> DataFrame:
    """Regions of texts around windows whose seed is in the bitmap, with their hits."""
    longest = max(map(len, masks.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value

        def has(p: np.ndarray) -> np.ndarray:
            return (known[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

        for batch in chunks(batches):
            words = Words(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found_at, found_h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, mask in masks.items():
                at, h = _seeds(words, mask, k)
                p1, p2 = _probes(h, bits)
                hit = np.flatnonzero(has(p1))
                hit = hit[has(p2[hit])]
                found_at.append(at[hit])
                found_h.append(h[hit])
            at, h = np.concatenate(found_at), np.concatenate(found_h)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            doc = np.searchsorted(words.first, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > margin)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(at))
            rows = []
            signed, tokens = h.view(np.int64), words.hashes.view(np.int64)
            for a, b in zip(heads, tails):
                d = doc[a]
                lo = max(int(at[a]) - margin, int(words.first[d]))
                hi = min(int(at[b - 1]) + longest + margin, int(words.first[d + 1]))
                base = int(words.first[d])
                rows.append((int(ids[d]), lo - base, tokens[lo:hi].tolist(), [{"pos": int(p) - base, "seed": int(s)} for p, s in zip(at[a:b], signed[a:b])]))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("pos", pa.int32()), ("seed", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "tokens", "hits"])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, _REGIONS)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, itokens): the hashed tokens of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(batch.column(1))
            tokens = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), longs(words.hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], ["item_id", "itokens"])

    return benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL").mapInArrow(run, "item_id long, itokens array<long>")


def _verify(pairs: DataFrame, window: int, share: float) -> DataFrame:
    """Lay both texts on the diagonal; the best window of each (document, item, diagonal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, item = np.array(r["tokens"]), np.array(r["itokens"])
                w = min(window, len(item))
                shift = r["diagonal"] - r["start"]  # of item token 0 within the region
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                if hi - lo < w or not w:
                    continue
                same = (doc[lo + shift : hi + shift] == item[lo:hi]).astype(np.int64)
                sums = np.cumsum(np.concatenate([[0], same]))
                sums = sums[w:] - sums[:-w]
                best = int(sums.argmax())
                if sums[best] >= share * w:
                    out.append((r["doc_id"], r["item_id"], r["diagonal"] + lo + best, lo + best, w, int(sums[best])))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_same"])

    return pairs.mapInArrow(run, "doc_id long, item_id long, doc_token long, item_token long, n_tokens long, n_same long")


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """One row per (doc_id, item_id) that overlap: the place and size of the best window
    (most equal tokens, then first in the document, then in the item)."""
    spark = docs.sparkSession
    seeds = persist(benchmark_seeds(benchmark, masks), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    of = dict(enumerate((*masks, *SHORT_MASKS)))
    used = {r["mask"]: of[r["mask"]] for r in seeds.select("mask").distinct().collect()}
    regions = persist(_regions(docs, bitmap, used, bits, window), "regions").withColumn("region", F.xxhash64("doc_id", "start", "tokens"))
    hits = regions.select("region", F.inline("hits"))
    if small(seeds, BROADCAST_SEEDS):
        seeds = F.broadcast(seeds)
    found = hits.join(seeds, "seed").select("region", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct()
    pairs = found.join(regions.drop("hits").dropDuplicates(["region"]), "region").join(_items(benchmark).distinct(), "item_id")
    best = F.max_by(F.struct("doc_token", "item_token", "n_tokens", "n_same"), F.struct("n_same", -F.col("doc_token"), -F.col("item_token")))
    return _verify(pairs.select("doc_id", "item_id", "start", "diagonal", "tokens", "itokens"), window, share).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that overlap with an item."""
    leaks = persist(contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"] == leaks["__leak"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document against every benchmark item."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    words = f"list_filter(string_split_regex(lower(text), '{SQL_SPLIT}'), lambda w: w <> '')"
    keys = []
    for m in (*MASKS, *SHORT_MASKS):
        picked = " || ' ' || ".join(f"w[p + {j}]" for j, c in enumerate(m) if c == "1")
        short = f" AND ('{{t}}' = 'd' OR len(w) IN {SHORT})" if m in SHORT_MASKS else ""
        keys.append(f"SELECT {{id}}, p, '{m} ' || {picked} AS k FROM {{t}}p WHERE p + {len(m) - 1} <= len(w){short}")
    both = " UNION ALL ".join(keys)
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
dp AS (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d),
bp AS (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM b),
dk AS ({both.format(id="doc_id", t="d")}),
bk AS ({both.format(id="item_id", t="b")}),
f AS (SELECT DISTINCT doc_id, item_id, dk.p - bk.p AS g FROM dk JOIN bk USING (k)),
e AS (SELECT f.doc_id, f.item_id, g, least({WINDOW}, len(b.w)) AS n, d.w AS dw, b.w AS bw,
        unnest(range(greatest(1, 1 - g), least(len(b.w), len(d.w) - g) - least({WINDOW}, len(b.w)) + 2)) AS s
      FROM f JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (SELECT doc_id, item_id, g + s - 1 AS doc_token, s - 1 AS item_token, n AS n_tokens,
        len(list_filter(range(0, n), lambda i: dw[g + s + i] = bw[s + i])) AS n_same FROM e)
SELECT doc_id, item_id, CAST(doc_token AS BIGINT) AS doc_token, CAST(item_token AS BIGINT) AS item_token,
  CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_same AS BIGINT) AS n_same
FROM v WHERE n_same >= {SHARE} * n_tokens
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same DESC, doc_token, item_token) = 1
"""


SQL = _sql()
