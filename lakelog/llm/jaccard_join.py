"""N-gram Jaccard join of documents: a size-aware heavy-light join.

The sets are the distinct word n-grams of whole texts; two documents are joined if the
Jaccard similarity of their sets reaches ``threshold``, and a group is a connected
component of the join.  Documents with equal sets are one set from the first step on, which
one document represents.

All grams have one order: rare ones first by a count sketch over all documents, then by
hash.  Sets of similarity t share at least k grams among their first
``|A| - ceil(t|A|) + k`` ones.  From these come the signatures:

* small sets (up to ``x`` grams) enumerate the 2-subsets of that prefix;
* large sets, and small ones large enough to match a large one, enter inverted lists of
  single grams (k = 3), which are scanned.

``x`` is the boundary of least cost: subsets enumerated below it against list entries and
chance meetings above it, from the histogram of sizes and the sketch.

An entry is ten bytes, five of the signature and five of the set, whatever the number of
buckets; buckets have a fixed number of entries.  Signatures with grams that the sketch
counts beyond ``HOT`` are spread over several buckets, and lists of more than ``PART`` sets
are kept in parts, so that no task holds a whole hot list.

Sets that share enough lists with a leader make clusters: cores of sets that are alike by
these counts, and around them sets that are less so, which connect no cores, so that
passages common to unlike documents don't chain them together.  Within a cluster all sets
are compared exactly, by products of matrices, block by block, so that links between m near
copies are all counted without m * m rows; links to copies count without being listed.
Across clusters every pair whose count of shared prefix grams allows the threshold is
checked exactly.  Only texts of sets that are compared are shuffled, compressed, and are read
again in slices of bounded size.  No meeting is left out, so components and counts of links
are exact (up to collisions of 64-bit hashes; shorter ones only add checks, the order only
decides the cost).

With n = 5 and a threshold of 0.5 a copy is found if two thirds of its grams are left:
when up to about 7 % of its words, evenly spread, were replaced.

Defined cases: null and empty texts have no grams and are in no group; a text of 1 to
n-1 words has one gram, all its words; repeated rows count once per doc_id; rows with a
null doc_id are in no group and are kept; an empty table gives no groups; only doc_id and
text are read.  A doc_id of several texts has the links of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelog.llm.storage import persist
from lakelog.llm.text import CHUNK_BYTES, SQL_SPLIT, U, Words, chunks, longs, mix

N = 5
THRESHOLD = 0.5
K = 3
CELLS = 1 << 18
BLOCKS = 16
#: Entries of a bucket on average, and those that a task gathers before it hands them on.
BUCKET_ENTRIES = 2_000_000
GATHER_ENTRIES = 500_000
#: Occurrences by the sketch, beyond its noise, from which a gram's signatures are spread.
HOT = 1 << 20
#: Sets in one row of a list.
PART = 4096
FILTER_BITS = 26
#: Pairs of sets that are looked at at a time.
PAIRS = 200_000
#: A set of no core is put to the core of its best leader from this part of a core's count on.
LEAN = 4
#: Sets and grams of a block; blocks of a cluster are compared two by two.
TILE = 1024
TILE_GRAMS = 1 << 19
#: What a pair counted by itself costs, in pairs counted by a product of matrices, and grams of a product.
DENSE = 100
COLUMNS = 1024
#: A set by the lower bits of its fingerprint; sets that share them are told apart when checked.
SET_BITS = 39
#: What a shared 2-subset counts: it is enough by itself.
SUBSET = 1 << 20
#: Edges, of 16 bytes, whose components are found on the driver.
LOCAL_EDGES = 500_000


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams sorted within their text, first of each text, sizes, and fingerprints of the sets."""
    grams, first = Words(texts).ngrams(n)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(first)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ U(0xA5A5A5A5)), dtype=np.uint64)])
    fp = mix((total[first[1:]] - total[first[:-1]]) + size.astype(np.uint64))
    return grams, first, size, fp


def _least(size, threshold: float):
    """The overlap that a set of this size needs with any partner."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _prefix(size, threshold: float, k: int):
    return np.minimum(size, size - _least(size, threshold) + k)


def _scan_sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, rid, fp, size), and of the sketch: (block, cells) once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.int64)
        names = ["doc_id", "rid", "fp", "size", "block", "cells"]
        for batch in chunks(batches):
            grams, _, size, fp = _sets(batch.column(2), n)
            sketch += np.bincount((grams & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
            k = len(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), longs(fp), pa.array(size, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names).filter(pa.array(size > 0))
        if sketch.any():
            cells = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in np.split(sketch, BLOCKS)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(BLOCKS, pa.int64())] * 3, pa.nulls(BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array(cells, pa.binary())], names)

    return docs.select("doc_id", _rid().alias("rid"), "text").mapInArrow(run, "doc_id long, rid long, fp long, size int, block int, cells binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """Counts of all grams, by cell; of fixed size, added up in two steps."""

    def add(kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, key = np.zeros(CELLS // BLOCKS, np.int64), None
            for batch in batches:
                key = batch.slice(0, 1).select(["salt", "block"]) if batch.num_rows else key
                for x in batch.column("cells"):
                    total += np.frombuffer(x.as_buffer(), kind)
            yield pa.RecordBatch.from_arrays([*key.columns, pa.array([total.tobytes()], pa.binary())], ["salt", "block", "cells"])

        return run

    kinds = "salt int, block int, cells binary"
    rows = scanned.filter("block IS NOT NULL").select((F.spark_partition_id() % 256).alias("salt"), "block", "cells")
    part = rows.groupBy("salt", "block").applyInArrow(add(np.int32), kinds).select(F.lit(0).alias("salt"), "block", "cells")
    out = np.zeros((BLOCKS, CELLS // BLOCKS), np.int64)
    for r in part.groupBy("salt", "block").applyInArrow(add(np.int64), kinds).collect():
        out[r.block] = np.frombuffer(r.cells, np.int64)
    return out.reshape(-1)


def boundary(sizes: dict[int, int], meetings: float, threshold: float, k: int = K) -> int:
    """The size x of least cost.  ``sizes``: number of sets by size; ``meetings``: other sets
    that an entry of a list meets on average."""
    best, x_best = math.inf, 0
    for x in range(0, 33):
        cost = 0.0
        for size, count in sizes.items():
            if size <= x:
                p = int(_prefix(np.int64(size), threshold, 2))
                cost += count * max(1, p * (p - 1) // 2)
            if size > threshold * x:
                cost += count * int(_prefix(np.int64(size), threshold, k)) * (1 + meetings)
        if cost < best:
            best, x_best = cost, x
    return x_best


def signatures(grams: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, salts: np.ndarray, threshold: float, x: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the index of their set, whether they are 2-subsets, and over how many
    buckets they are spread.  ``order``: rank of each gram, rare first, ties broken by the
    gram itself; ``salts``: over how many buckets a gram is spread."""
    doc = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((grams, order, doc))
    grams, salts = grams[by], salts[by]
    place = np.arange(len(grams)) - first[doc]
    single = (size > threshold * x)[doc] & (place < _prefix(size, threshold, k)[doc])
    sig, of, spread = [mix(grams[single])], [doc[single]], [salts[single]]
    subsets = 0
    for d in np.flatnonzero((size <= x) & (size > 0)):
        p = int(_prefix(size[d], threshold, 2))
        g, s = grams[first[d] : first[d] + p], salts[first[d] : first[d] + p]
        a, b = np.triu_indices(p, 1)
        h, s2 = mix(g[a] * U(0x9E3779B97F4A7C15) + g[b]), np.minimum(s[a], s[b])
        if _least(size[d], threshold) < 2:
            # an overlap of 1 may do: the grams themselves are subsets too
            h, s2 = np.concatenate([h, mix(g ^ U(0x1111))]), np.concatenate([s2, s])
        sig.append(h)
        of.append(np.full(len(h), d))
        spread.append(s2)
        subsets += len(h)
    sig, of, spread = np.concatenate(sig), np.concatenate(of), np.concatenate(spread)
    two = np.zeros(len(sig), bool)
    two[len(sig) - subsets :] = True
    return sig, of, two, spread


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lower bytes of 64-bit values, a row each."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width])


def _unpack(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view(np.uint64).reshape(-1)


LISTS = "key long, part long, shared long, lead long, long boolean, sids array<long>"


def _met(sig: np.ndarray, entry: np.ndarray, bucket: int, hot: bool, part: int) -> pa.RecordBatch:
    """The lists among entries of a bucket (``entry``: the set, and in the last bit whether
    by a 2-subset): rows of ``LISTS``, lists of equal sets as one."""
    if not hot:  # signatures that occur once go before anything else is done
        by = np.argsort(sig)
        sig, entry = sig[by], entry[by]
        multi = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        multi[1:] |= same
        multi[:-1] |= same
        sig, entry = sig[multi], entry[multi]
    by = np.lexsort((entry, sig))
    sig, entry = sig[by], entry[by]
    sid = entry >> U(1)
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
    sig, sid, two = sig[new], sid[new], entry[new] & U(1)
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.append(head, len(sig)))
    if not hot:
        head, length = head[length > 1], length[length > 1]
    weight = np.where(two[head] == 1, SUBSET, 1)
    if hot:
        key, shared, base = sig[head], weight, bucket << 20
    else:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sid), dtype=np.uint64)])
        key = mix(total[head + length] - total[head] + length.astype(np.uint64))
        key, at, inv = np.unique(key, return_index=True, return_inverse=True)
        shared, base = np.bincount(inv, weights=weight, minlength=len(key)).astype(np.int64), 0
        head, length = head[at], length[at]
    parts = -(-length // part)
    row = np.repeat(np.arange(len(head)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = head[row] + number * part
    size = np.minimum(length[row] - number * part, part)
    off = np.concatenate([[0], np.cumsum(size)])
    values = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    signed = sid.view(np.int64)
    sids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(signed[values]))
    long = np.ones(len(row), bool) if hot else parts[row] > 1
    cols = [longs(key[row]), pa.array(number + base), pa.array(shared[row]), pa.array(signed[head[row]]), pa.array(long), sids]
    return pa.RecordBatch.from_arrays(cols, ["key", "part", "shared", "lead", "long", "sids"])


def _lists(docs: DataFrame, n: int, threshold: float, k: int, x: int, buckets: int, sketch, hot: int, part: int) -> DataFrame:
    """``LISTS`` of the sets that share signatures; long ones are to be joined by key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.minimum(sketch.value, 2**62)
        # counts within the noise of the sketch rank alike, so that hashes decide
        noise = cells.mean()
        rank_of = np.where(cells < noise + 4 * math.sqrt(noise + 1), 0, cells)
        salts_of = np.maximum(1, np.ceil((cells - noise) / hot)).astype(np.int64)
        seen: set[int] = set()  # equal sets of a task count once
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            sig, entry, bucket, spread = (np.concatenate(c) for c in zip(*held))
            held.clear()
            by = np.lexsort((bucket, spread))
            sig, entry, bucket, spread = sig[by], entry[by], bucket[by], spread[by]
            cut = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(spread, prepend=-1) != 0))
            ends = np.append(cut[1:], len(sig))
            narrow, wide, ids = _pack(sig, 5), _pack(sig, 8), _pack(entry, 5)
            sigs = [(wide if s else narrow)[a:b].tobytes() for a, b, s in zip(cut, ends, spread[cut])]
            cols = [pa.array(bucket[cut], pa.int32()), pa.array(spread[cut], pa.bool_()), pa.array(sigs, pa.binary()), pa.array([ids[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "hot", "sigs", "ids"])

        for batch in chunks(batches):
            grams, first, size, fp = _sets(batch.column(1), n)
            once = np.zeros(len(fp), bool)
            for d in np.flatnonzero(size > 0).tolist():
                if (f := int(fp[d])) not in seen:
                    seen.add(f)
                    once[d] = True
            if not once.any():
                continue
            grams, fp, size = grams[np.repeat(once, size)], fp[once], size[once]
            first = np.concatenate([[0], np.cumsum(size)])
            cell = (grams & U(CELLS - 1)).astype(np.int64)
            sig, of, two, salts = signatures(grams, first, size, rank_of[cell], salts_of[cell], threshold, x, k)
            sid = (fp & U((1 << SET_BITS) - 1))[of]
            spread = salts > 1
            bucket = ((sig >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            bucket = np.where(spread, (bucket + (mix(sid) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64)) % buckets, bucket)
            held.append((sig, sid << U(1) | two.astype(np.uint64), bucket, spread))
            n_held += len(sig)
            if n_held >= GATHER_ENTRIES:
                yield flush()
                n_held = 0
        if held:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        out = []
        number = rows.column("bucket")[0].as_py()
        for kind in (False, True):
            some = rows.filter(pc.equal(rows.column("hot"), kind))
            sigs, ids = some.column("sigs").to_pylist(), some.column("ids").to_pylist()
            if not sigs:
                continue
            sig, entry = _unpack(sigs, 8 if kind else 5), _unpack(ids, 5)
            slices = max(1, len(sig) // GATHER_ENTRIES)
            which = mix(sig) % U(slices) if slices > 1 else np.zeros(len(sig), np.uint64)
            for s in range(slices):
                mine = which == U(s)
                out.append(_met(sig[mine], entry[mine], number, kind, part))
        return pa.Table.from_batches(out)

    packed = docs.mapInArrow(scan, "bucket int, hot boolean, sigs binary, ids binary")
    return packed.groupBy("bucket").applyInArrow(meet, LISTS)


def _rid() -> Column:
    """A row by its doc_id and its text."""
    return F.xxhash64("doc_id", "text")


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for what is planned inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, text) of the rows in ``wanted``; a bitmap of fixed size thins the scan out, joins decide."""
    spark = docs.sparkSession
    mask = (1 << FILTER_BITS) - 1
    at = F.col("rid").bitwiseAND(F.lit(mask))
    words = wanted.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((rid & {mask}) & 63 AS INT))")).alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    known = spark.sparkContext.broadcast(bits.view(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            p = (batch.column(0).to_numpy().view(np.uint64) & U(mask)).astype(np.int64)
            yield batch.filter(pa.array((table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))

    found = docs.select(_rid().alias("rid"), "text").mapInArrow(run, "rid long, text string")
    return found.groupBy("rid").agg(F.first("text").alias("text"))


def _verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b, ra, rb: representing rows) those that reach the threshold, with their similarity."""
    with _batches(docs.sparkSession, 256):
        pairs = persist(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.explode(F.array("ra", "rb")).alias("rid")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            rb = batch.column(4).to_numpy()
            held = np.cumsum(pc.binary_length(ta).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(rb):
                end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + CHUNK_BYTES, "right")))
                # rows come in the order of rb: its text is read once for each run of rows
                new = np.ones(end - at, bool)
                new[1:] = rb[at + 1 : end] != rb[at : end - 1]
                of = np.cumsum(new) - 1
                left, right = _sets(ta.slice(at, end - at), n), _sets(tb.slice(at, end - at).filter(pa.array(new)), n)
                j = np.zeros(end - at)
                for i in range(end - at):
                    x = left[0][left[1][i] : left[1][i + 1]]
                    y = right[0][right[1][of[i]] : right[1][of[i] + 1]]
                    if len(x) and len(y):
                        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        j[i] = both / (len(x) + len(y) - both)
                ok = pa.array(j >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array(j)], ["a", "b", "jaccard"]).filter(ok)
                at = end

    left, right = (texts.select(F.col("rid").alias(f"r{c}"), F.col("text").alias(f"t{c}")) for c in "ab")
    rows = pairs.join(left.hint("merge"), "ra").join(right.hint("merge"), "rb").select("a", "b", "ta", "tb", "rb")
    with _batches(docs.sparkSession, 256):
        return persist(rows.mapInArrow(run, "a long, b long, jaccard double"), "verified")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and the least one of the component of each."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(ends))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return ends, ends[root]


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(fp, label): the least fp of each connected component, for every end of an edge.

    In each round all ends go to their least neighbour, or stay if they are less, and edges
    go with them; ends are hashes, so that a constant part of them is left, however long
    the chains are.  From ``local`` edges on the driver does the rest."""
    spark = edges.sparkSession
    both = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = persist(edges.select(*both).filter("a <> b").distinct(), "edges")
    labels = None

    def moved(step: DataFrame) -> DataFrame:
        if labels is None:
            return step.toDF("fp", "label")
        return labels.join(step, labels["label"] == step["end"], "left").select("fp", F.coalesce("to", "label").alias("label"))

    while edges.count() > local:
        step = edges.union(edges.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "end")
        step = persist(step, "steps")
        labels = persist(moved(step), "labels")
        edges = edges.join(step.toDF("a", "ta"), "a").join(step.toDF("b", "tb"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        edges = persist(edges.select(*both).filter("a <> b").distinct(), "edges")
    rest = edges.toArrow()
    ends, to = _roots(rest.column("a").to_numpy(), rest.column("b").to_numpy())
    return persist(moved(spark.createDataFrame(pa.table({"end": ends, "to": to}), "end long, to long")), "labels")


def _need(za: Column, zb: Column, threshold: float, k: int) -> Column:
    """How many prefix grams sets of these sizes share at least, if they reach the threshold."""
    least = F.ceil((za + zb) * (threshold / (1 + threshold)) - 1e-9) - F.greatest(F.ceil(F.greatest(za, zb) * threshold - 1e-9) - k, F.lit(0))
    return F.least(F.greatest(least, F.lit(1)), F.least(za, zb))


def _alike(za: Column, zb: Column, threshold: float, k: int) -> Column:
    """How many prefix grams sets of these sizes share, if they are in one cluster: those they
    need, which are few for unlike sizes, and about three quarters of what the smaller one's prefix
    has in common with an equally large set at the threshold, which a passage alone hasn't."""
    z = F.least(za, zb)
    prefix = F.least(z, z - F.ceil(z * threshold - 1e-9) + k)
    return F.greatest(_need(za, zb, threshold, k), F.ceil(prefix * (1.5 * threshold / (1 + threshold)) - 1e-9))


def _stars(lists: DataFrame) -> DataFrame:
    """(a, b, shared): sets with the leaders of their lists, and how many lists they have in common with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            off, v = col.offsets.to_numpy(), col.flatten().to_numpy()
            length = np.diff(off)
            b, s = (np.repeat(batch.column(c).to_numpy(), length) for c in (1, 0))
            keep = v != b
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(b[keep]), pa.array(s[keep])], ["a", "b", "shared"])

    edges = lists.select("shared", "lead", "sids").mapInArrow(run, "a long, b long, shared long")
    # the parts of a list that is spread over buckets have leaders of their own
    leads = lists.filter("long").groupBy("key", "lead").agg(F.max("shared").alias("shared"))
    top = leads.groupBy("key").agg(F.min("lead").alias("top"))
    linked = leads.join(top, "key").filter("lead <> top").select(F.col("lead").alias("a"), F.col("top").alias("b"), "shared")
    return edges.union(linked).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _across(lists: DataFrame, known: DataFrame, threshold: float, k: int, part: int) -> DataFrame:
    """(a, b): pairs of different clusters whose count of shared prefix grams allows the threshold."""
    return candidates(lists, known, threshold, k, part).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("a", "b")


def candidates(lists: DataFrame, known: DataFrame, threshold: float, k: int, part: int) -> DataFrame:
    """(a, b, shared, need): a row for each list that two sets of different clusters share.  A
    pair shares no more than either of its sets has in lists of several clusters; pairs that
    need more than that, most of those that meet by chance, have no rows."""
    rows = lists.select("key", "part", "shared", "long", F.explode("sids").alias("sid")).join(known, "sid").drop("sid")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rows = persist(rows.join(mixed, "key", "left_semi"), "entries")
    rows = rows.join(rows.groupBy("fp").agg(F.sum("shared").alias("most")), "fp")
    # long lists are cut anew in the order of clusters, so that most parts are of one
    place = F.row_number().over(Window.partitionBy("key").orderBy("label", "fp")) - 1
    cut = rows.filter("long").withColumn("part", F.floor(place / part).cast("long"))
    member = F.struct("label", "fp", "size", "most")
    tagged = [x.groupBy("key", "part", "shared").agg(F.sort_array(F.collect_list(member)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")) for x in (rows.filter("NOT long"), cut)]
    short = tagged[0].filter("lo <> hi").select("shared", "m", F.lit(None).cast("array<struct<label:long,fp:long,size:int,most:long>>").alias("other"))
    # parts of long lists meet in pairs, and each with itself
    long = persist(tagged[1], "long")
    other = long.select("key", F.col("part").alias("part2"), F.col("m").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = long.join(other, "key").filter("part <= part2 AND least(lo, lo2) <> greatest(hi, hi2)")
    met = met.select("shared", "m", F.when(F.col("part") < F.col("part2"), F.col("other")).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, other = batch.column(1), batch.column(2)
            begin, n1 = m.offsets.to_numpy()[:-1] - m.offsets.to_numpy()[0], np.diff(m.offsets.to_numpy())
            begin2, n2 = other.offsets.to_numpy()[:-1] - other.offsets.to_numpy()[0] + n1.sum(), np.diff(other.offsets.to_numpy())
            same = other.is_null().to_numpy(zero_copy_only=False)
            g, f, z, most = (np.concatenate([m.flatten().field(c).to_numpy(), other.flatten().field(c).to_numpy()]) for c in range(4))
            shared = batch.column(0).to_numpy()
            # each member with all of the other side, so many at a time; within a list, with
            # what comes after its own cluster, as members are sorted by cluster
            row = np.repeat(np.arange(batch.num_rows), n1)
            mine = np.arange(len(row))
            last = np.ones(len(row), bool)
            last[:-1] = (row[1:] != row[:-1]) | (g[: len(row)][1:] != g[: len(row)][:-1])
            after = (np.flatnonzero(last) + 1)[np.cumsum(last) - last]
            start = np.where(same[row], after, begin2[row])
            count = np.where(same[row], (begin + n1)[row] - after, n2[row])
            todo = np.cumsum(count)
            at = 0
            while at < len(row):
                end = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + PAIRS, "right")))
                times = count[at:end]
                p = np.repeat(mine[at:end], times)
                r = row[p]
                q = start[p] + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)
                zs, zl = np.minimum(z[p], z[q]), np.maximum(z[p], z[q])
                ok = np.flatnonzero((g[p] != g[q]) & (zs >= threshold * zl - 1e-9))
                p, q, r, zs, zl = p[ok], q[ok], r[ok], zs[ok], zl[ok]
                need = np.ceil((zs + zl) * (threshold / (1 + threshold)) - 1e-9) - np.maximum(np.ceil(zl * threshold - 1e-9) - k, 0)
                need = np.minimum(np.maximum(need, 1), zs).astype(np.int32)
                ok = np.minimum(most[p], most[q]) >= need
                p, q, r, need = p[ok], q[ok], r[ok], need[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(f[p], f[q])), pa.array(np.maximum(f[p], f[q])), pa.array(shared[r]), pa.array(need)], ["a", "b", "shared", "need"])
                at = end

    return short.union(met).mapInArrow(run, "a long, b long, shared long, need int")


def overlaps(grams: np.ndarray, of: np.ndarray, left: int, right: int) -> np.ndarray:
    """How many grams each of the sets 0 to left-1 shares with each of those from left on.
    ``of``: the set of each gram.  Frequent grams are multiplied as matrices, the others
    are counted pair by pair, whichever costs less."""
    out = np.zeros((left, right), np.float32)
    by = np.lexsort((of, grams))
    grams, of = grams[by], of[by]
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(grams)))
    n1 = np.add.reduceat(of < left, head, dtype=np.int64) if len(head) else n
    keep = (n1 > 0) & (n1 < n)
    head, n1, n2 = head[keep], n1[keep], (n - n1)[keep]
    dense = n1 * n2 * DENSE > left * right
    a, b, m1, m2 = head[dense], (head + n1)[dense], n1[dense], n2[dense]
    for at in range(0, len(a), COLUMNS):
        x, y = (np.zeros((rows, min(COLUMNS, len(a) - at)), np.float32) for rows in (left, right))
        for matrix, begin, count, base in ((x, a, m1, 0), (y, b, m2, left)):
            begin, count = begin[at : at + COLUMNS], count[at : at + COLUMNS]
            places = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            matrix[of[places] - base, np.repeat(np.arange(len(count)), count)] = 1
        out += x @ y.T
    a, b, m1, m2 = head[~dense], (head + n1)[~dense], n1[~dense], n2[~dense]
    todo = np.cumsum(m1 * m2)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + PAIRS, "right")))
        times = (m1 * m2)[at:end]
        g = np.repeat(np.arange(at, end), times)
        k = np.arange(len(g)) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(out.reshape(-1), of[a[g] + k // m2[g]] * right + of[b[g] + k % m2[g]] - left, np.float32(1))
        at = end
    return out


def forest(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the true places of ``ok`` (rows, columns), that connect all that it connects."""
    turned = np.ascontiguousarray(ok.T)
    new = [ok.any(1), ok.any(0)]
    rows, columns = [], []
    for start in np.flatnonzero(new[0]).tolist():
        stack = [(0, start)] if new[0][start] else []
        new[0][start] = False
        while stack:
            side, v = stack.pop()
            found = np.flatnonzero((turned if side else ok)[v] & new[1 - side])
            new[1 - side][found] = False
            for x, y in ((rows, columns),) if not side else ((columns, rows),):
                x.append(np.full(len(found), v))
                y.append(found)
            stack += [(1 - side, w) for w in found.tolist()]
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(rows + empty), np.concatenate(columns + empty)


def _within(docs: DataFrame, known: DataFrame, n: int, threshold: float, tile: int, most: int) -> DataFrame:
    """All sets of each cluster compared with each other: (a, b, null) for links that connect
    all that is linked, and (a, null, n) for the n documents of other sets that a is linked
    with, in parts.  ``known``: (fp, size, rid, copies, label).  A cluster is cut into blocks of
    about ``tile`` sets or ``most`` grams, of which each two meet in a task of their own."""
    many = known.groupBy("label").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).filter("m > 1")
    many = persist(many.withColumn("blocks", F.ceil(F.greatest(F.col("m") / tile, F.col("grams") / most)).cast("int")), "clusters")
    # small clusters share tasks
    bins = max(1, math.ceil((many.filter("blocks = 1").agg(F.sum("grams")).first()[0] or 0) / most))
    rows = known.join(many, "label").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bin_ = F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(bins)))
    rows = rows.select("rid", bin_.alias("bin"), F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "label", "fp", "copies", "block")
    texts = _texts(docs, known.join(many, "label", "left_semi").select("rid"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        rows = rows.sort_by([("label", "ascending"), ("block", "ascending")])
        label, fp, copies, block = (rows.column(c).to_numpy() for c in ("label", "fp", "copies", "block"))
        found = [_sets(b.column(0), n)[:3] for b in chunks(rows.select(["text"]).to_batches())]
        grams, size = (np.concatenate([x[c] for x in found]) for c in (0, 2))
        first = np.concatenate([[0], np.cumsum(size)])
        cut = np.append(np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])), len(label))
        out = [(np.zeros(0, np.int64),) * 2]
        counts = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in zip(cut[:-1], cut[1:]):
            mid = hi if i == j else lo + int((block[lo:hi] == i).sum())
            g, of = grams[first[lo] : first[hi]], np.repeat(np.arange(hi - lo), size[lo:hi])
            if i == j:  # the cluster meets itself
                both = overlaps(np.tile(g, 2), np.concatenate([of, of + (hi - lo)]), hi - lo, hi - lo)
                right = slice(lo, hi)
            else:
                both = overlaps(g, of, mid - lo, hi - mid)
                right = slice(mid, hi)
            left = slice(lo, mid)
            ok = both / (size[left][:, None] + size[right][None, :] - both) >= threshold - 1e-12
            if i == j:
                np.fill_diagonal(ok, False)
            r, c = forest(ok)
            out.append((fp[left][r], fp[right][c]))
            counts.append((fp[left], ok @ copies[right]))
            if i != j:
                counts.append((fp[right], ok.T @ copies[left]))
        a, b = (np.concatenate(x) for x in zip(*out))
        f, m = (np.concatenate(x) for x in zip(*counts))
        f, m = f[m > 0], m[m > 0]
        return pa.table({"a": np.concatenate([a, f]), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(f), pa.int64())]), "n": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(m, pa.int64())])})

    shipped = rows.join(texts.hint("merge"), "rid").select("bin", "i", "j", "label", "fp", "copies", "block", "text")
    return persist(shipped.groupBy("bin", "i", "j").applyInArrow(run, "a long, b long, n long"), "within")


def _joined(docs: DataFrame, n: int, threshold: float, k: int, hot: int, part: int, tile: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, label of the component) of all documents with grams, and (fp, n): the
    documents of other sets that a set is linked with, in parts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    scanned = persist(_scan_sets(docs, n), "scanned")
    ids = scanned.filter("block IS NULL").select("doc_id", "fp").distinct()
    sketch = _sketch(scanned)
    sets = scanned.filter("block IS NULL").groupBy("fp", "doc_id").agg(F.max("size").alias("size"), F.min("rid").alias("rid"))
    sets = persist(sets.groupBy("fp").agg(F.max("size").alias("size"), F.min("rid").alias("rid"), F.count("*").alias("copies")), "sets")
    sizes: dict[int, int] = {}
    total = 0.0
    for r in sets.groupBy(F.least("size", F.lit(64)).alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("grams")).collect():
        sizes[r["size"]] = r["n"]
        total += r["grams"] * (1 - threshold) + k * r["n"]
    noise = sketch.mean() if sketch.any() else 0.0
    meetings = float((np.maximum(sketch - noise, 0) > 4 * math.sqrt(noise + 1)).mean()) + 1.0
    x = boundary(sizes, meetings, threshold, k)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_ENTRIES))
    met = _lists(docs, n, threshold, k, x, buckets, spark.sparkContext.broadcast(sketch), hot, part)
    lists = persist(met.groupBy("key", "part", "long").agg(F.sum("shared").alias("shared"), F.min("lead").alias("lead"), F.first("sids").alias("sids")), "lists")

    # clusters: sets and the leaders they may be linked with, by the counts alone
    sid = F.col("fp").bitwiseAND(F.lit((1 << SET_BITS) - 1)).alias("sid")
    ends = [sets.select(sid.alias(c), F.col("fp").alias(f"f{c}"), F.col("size").alias(f"z{c}")) for c in "ab"]
    star = _stars(lists).filter(F.col("shared") >= k).join(ends[0], "a").join(ends[1], "b")
    # sizes too unlike for a link make no cluster
    star = star.filter(F.least("za", "zb") >= F.greatest("za", "zb") * threshold - 1e-9).withColumn("need", _alike(F.col("za"), F.col("zb"), threshold, k))
    star = persist(star.filter(F.col("shared") * LEAN >= F.col("need")).select("fa", "fb", "shared", "need"), "stars")
    cores = components(star.filter("shared >= need").select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    # sets of no core go to that of their best leader, which connects no cores
    best = star.join(cores, star["fa"] == cores["fp"], "left_anti").groupBy("fa").agg(F.max_by("fb", F.struct("shared", "fb")).alias("fb"))
    around = best.join(cores, best["fb"] == cores["fp"], "left").select(F.col("fa").alias("fp"), F.coalesce("label", "fb").alias("label"))
    known = persist(sets.join(cores.union(around), "fp", "left").select(sid, "fp", "size", "rid", "copies", F.coalesce("label", "fp").alias("label")), "known")
    within = _within(docs, known.drop("sid"), n, threshold, tile, most)

    # pairs across clusters that the counts allow
    pairs = _across(lists, known.select("sid", "fp", "size", "label"), threshold, k, part)
    rows = [sets.select(F.col("fp").alias(c), F.col("rid").alias(f"r{c}")) for c in "ab"]
    across = _verified(docs, pairs.join(rows[0], "a").join(rows[1], "b").select("a", "b", "ra", "rb"), n, threshold).select("a", "b")
    labels = components(within.filter("b IS NOT NULL").select("a", "b").union(across))
    of = ids.join(labels, "fp", "left").select("doc_id", "fp", F.coalesce("label", "fp").alias("label"))
    copies = sets.select(F.col("fp").alias("b"), F.col("copies").alias("n"))
    linked = across.union(across.select("b", "a")).join(copies, "b").select(F.col("a").alias("fp"), "n")
    own = sets.select("fp", (F.col("copies") - 1).alias("n"))
    return of, within.filter("b IS NULL").select(F.col("a").alias("fp"), "n").union(linked).union(own)


def _named(of: DataFrame) -> DataFrame:
    """(label, group_id, n_docs) of components of more than one document."""
    return of.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.countDistinct("doc_id").alias("n_docs")).filter("n_docs > 1")


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, k: int = K, hot: int = HOT, part: int = PART, tile: int = TILE, most: int = TILE_GRAMS) -> DataFrame:
    """(doc_id, group_id, n_docs) of every document that is joined with another one; group_id
    is the least doc_id of its group, n_docs the number of its documents."""
    of, _ = _joined(docs, n, threshold, k, hot, part, tile, most)
    return of.select("doc_id", "label").distinct().join(_named(of), "label").select("doc_id", "group_id", "n_docs")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, k: int = K, hot: int = HOT, part: int = PART, tile: int = TILE, most: int = TILE_GRAMS) -> DataFrame:
    """``groups`` with n_links: the number of documents that a document itself is joined with."""
    of, counts = _joined(docs, n, threshold, k, hot, part, tile, most)
    mine = of.join(counts.groupBy("fp").agg(F.sum("n").alias("n")), "fp").groupBy("doc_id", "label").agg(F.sum("n").alias("n_links"))
    return mine.join(_named(of), "label").select("doc_id", "group_id", "n_docs", "n_links")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents of a group, but for the one of least doc_id."""
    found = groups(docs, **how)
    gone = persist(found.filter("doc_id <> group_id").select(F.col("doc_id").alias("__copy")).distinct(), "copies")
    return docs.join(gone, docs["doc_id"] == gone["__copy"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents joined with each other; one row for each that has a partner."""
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{SQL_SPLIT}'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {N - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {N} + 2))) AS p FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS z FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE o >= {THRESHOLD} * (za.z + zb.z - o) - 1e-9),
r AS (SELECT a AS doc_id, a AS top FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.top),
c AS (SELECT doc_id, min(top) AS group_id FROM r GROUP BY 1)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n_docs, (SELECT count(*) FROM e WHERE e.a = c.doc_id) AS n_links FROM c
"""
