"""Token ids of documents as canonical length-limited Huffman code.

Texts are encoded by a public byte-level BPE vocabulary (``vocabulary`` is its path; none is
trained).  Pieces are found by the vocabulary's own pattern over arrays of characters, and
each distinct piece of a worker is encoded once.  Ids are written once to the shared folder;
their global counts give code lengths of at most ``LIMIT`` bits (package-merge, optimal under
the limit), and the lengths alone give the canonical code.

A block holds the ids of up to ``BLOCK_TOKENS`` tokens of one document; blocks decode
independently, and every ``CHECKPOINT`` tokens a bit offset is kept, from which decoding can
start.  Decoding looks ``LIMIT`` bits up in one table, all checkpoints of a batch in step.

The result holds its own code: one row of block -1 has the code lengths (id, n_tokens, bits)
in ``lengths``, which is null in all blocks.  ``decode_blocks`` reads nothing else.  The query
writes its rows, decodes what it wrote and compares it with the ids; it fails if they differ.

Defined cases: a null text has no block; an empty one neither; invalid surrogates can't
occur in Spark's strings; rows with a null doc_id keep it; repeated rows give repeated
blocks; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.storage import persist
from lakelog.llm.text import U, chunks, mix, power_tables

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 16
BLOCK_TOKENS = 1 << 16
CHECKPOINT = 256

BLOCKS = "doc_id long, block int, n_tokens int, n_bits long, checkpoints array<long>, code binary"
RESULT = f"{BLOCKS}, lengths array<struct<id:int,n_tokens:long,bits:int>>"


# ---- tokens

@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The vocabulary as an encoder, one per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Each character's class in the pattern."""
    import regex

    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    out = np.full(0x110000, _OTHER, np.uint8)
    at = np.array([ord(c) for c in every])
    text = "".join(every)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def piece_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern starts at each character; texts without apostrophes."""
    n = len(chars)
    kind = _classes()[chars]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head = head[:n]
    before = np.concatenate([[9], kind[:-1]])
    after = np.concatenate([kind[1:], [9]])
    ends = np.zeros(n, bool)
    ends[first[1:][np.diff(first) > 0] - 1] = True
    after[ends] = 9
    space = kind == _SPACE
    # a run of spaces gives its last character to what follows: a blank is glued to it,
    # another one stands alone
    last = space & (after != _SPACE) & (after != 9)
    starts = head | (kind != before) | last
    glued = np.zeros(n, bool)
    glued[1:] = last[:-1] & (chars[:-1] == 32)
    glued &= ~space & ~head
    return starts & ~glued


def piece_hashes(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of the characters."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    power, inverse = power_tables(len(chars) + 1)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + U(1)) * U(0xBF58476D1CE4E5B9) * power[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


class Encoder:
    """Ids of texts.  Each distinct piece is encoded once; up to about ``most`` of them are kept.
    Known pieces are found by a table of hashes with open addressing, all of a batch in step."""

    def __init__(self, vocabulary: str, most: int = 1_000_000):
        self.encoding, self.most = encoding(vocabulary), most
        self._clear()

    def _clear(self) -> None:
        self.known = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0
        self.key, self.start, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.table = np.full(1 << 15, -1, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 if it isn't known."""
        mask = len(self.table) - 1
        place = (keys & U(mask)).astype(np.int64)
        out = self.table[place]
        todo = np.flatnonzero((out >= 0) & (self.key[out] != keys))
        while len(todo):
            place[todo] = (place[todo] + 1) & mask
            out[todo] = found = self.table[place[todo]]
            todo = todo[(found >= 0) & (self.key[found] != keys[todo])]
        return out

    def _enter(self, numbers: np.ndarray) -> None:
        """Put pieces that aren't in the table there."""
        mask = len(self.table) - 1
        place = (self.key[numbers] & U(mask)).astype(np.int64)
        while len(numbers):
            free = self.table[place] < 0
            self.table[place[free]] = numbers[free]
            rest = self.table[place] != numbers
            numbers, place = numbers[rest], (place[rest] + 1) & mask

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        old, self.known = self.known, self.known + len(ids)
        used, self.used = self.used, self.used + int(size.sum())
        if self.known > len(self.key):
            self.key, self.start, self.size = (np.resize(x, 2 * self.known) for x in (self.key, self.start, self.size))
        if self.used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * self.used)
        self.pool[used : self.used] = np.fromiter(chain.from_iterable(ids), np.uint16, self.used - used)
        self.key[old : self.known], self.size[old : self.known] = keys, size
        self.start[old : self.known] = used + np.cumsum(size) - size
        if 2 * self.known > len(self.table):
            self.table = np.full(1 << (4 * self.known - 1).bit_length(), -1, np.int32)
            old = 0
        self._enter(np.arange(old, self.known, dtype=np.int32))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first of each text."""
        listed = ["" if x is None else x for x in texts.to_pylist()]
        plain = [("" if "'" in x else x) for x in listed]
        joined = "".join(plain)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(x) for x in plain])])
        begin = np.flatnonzero(piece_starts(chars, first)) if len(chars) else np.zeros(0, int)
        end = np.append(begin[1:], len(chars)) if len(begin) else begin
        hashes = piece_hashes(chars, begin, end)
        if self.known > self.most:
            self._clear()
        encode = self.encoding.encode_ordinary
        of = self._find(hashes)
        new = np.flatnonzero(of < 0)
        keys, at, piece = np.unique(hashes[new], return_index=True, return_inverse=True)
        of[new] = self.known + piece
        self._add(keys, [encode(joined[i:j]) for i, j in zip(begin[new[at]].tolist(), end[new[at]].tolist())])
        size = self.size[of].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.pool[np.repeat(self.start[of] - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(begin, first)]
        if any("'" in x for x in listed):
            rows = [np.array(encode(x), np.uint16) if "'" in x else out[cut[i] : cut[i + 1]] for i, x in enumerate(listed)]
            cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            out = np.concatenate(rows)
        return out, cut


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """A worker's, with the pieces of its tasks before."""
    return Encoder(vocabulary)


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the 16-bit ids of each text that has any, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in chunks(batches):
            ids, first = known.ids(batch.column(1))
            cells = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((2 * first).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), cells.cast(pa.binary())], ["doc_id", "ids"]).filter(pa.array(np.diff(first) > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all cells, and the first of each."""
    first = np.concatenate([[0], np.cumsum(pc.binary_length(cells).to_numpy(zero_copy_only=False))]) // 2
    return np.frombuffer(b"".join(cells.to_pylist()), "<u2"), first.astype(np.int64)


# ---- the code

def code_lengths(n: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge); one symbol gets 1 bit."""
    m = len(n)
    if m <= 1:
        return np.ones(m, np.int64)
    if m > 1 << limit:
        raise ValueError(f"{m} symbols don't fit into {limit} bits")
    order = np.argsort(n, kind="stable")
    coins = n[order].astype(np.float64)
    # packages of each level: weights, and how many of the cheapest coins they hold
    rounds: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([coins, packages])
        is_coin = np.concatenate([np.ones(m, bool), np.zeros(len(packages), bool)])
        by = np.argsort(merged, kind="stable")
        merged, is_coin = merged[by], is_coin[by]
        rounds.append(is_coin)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    # walk back: of the last level the first 2m - 2 are taken
    length = np.zeros(m, np.int64)
    take = 2 * m - 2
    for is_coin in reversed(rounds):
        chosen = is_coin[:take]
        k = int(chosen.sum())
        length[:k] += 1
        take = 2 * (len(chosen) - k)
    out = np.empty(m, np.int64)
    out[order] = length
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By id: the canonical code words, and their lengths (0: not in the code)."""
    code, length = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
    order = np.lexsort((ids, lengths))
    at = 0
    for k, i in enumerate(order):
        if k:
            at = (at + 1) << int(lengths[i] - lengths[order[k - 1]])
        code[ids[i]], length[ids[i]] = at, lengths[i]
    return code, length


def decode_table(code: np.ndarray, length: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """By the next ``limit`` bits: the id, and the bits that it takes."""
    ids, bits = np.zeros(1 << limit, np.uint16), np.ones(1 << limit, np.uint8)
    for i in np.flatnonzero(length):
        a = int(code[i]) << int(limit - length[i])
        ids[a : a + (1 << int(limit - length[i]))] = i
        bits[a : a + (1 << int(limit - length[i]))] = length[i]
    return ids, bits


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, first bit first, padded to bytes; the bit offset of each id, and the total."""
    bits = length[ids]
    offset = np.concatenate([[0], np.cumsum(bits)])
    total = int(offset[-1])
    words = np.zeros(total // 32 + 2, np.uint64)
    at, shift = offset[:-1] >> 5, offset[:-1] & 31
    wide = code[ids] << (64 - bits - shift).astype(np.uint64)
    head = np.flatnonzero(np.diff(at, prepend=-1))
    if len(head):
        # code words of one 32-bit word don't overlap: their sum is their union
        words[at[head]] = np.add.reduceat(wide >> np.uint64(32), head)
        spill = np.add.reduceat(wide & np.uint64(0xFFFFFFFF), head)
        words[at[head] + 1] += spill
    return words.astype(">u4").tobytes()[: (total + 7) // 8], offset


def encode_blocks(tokens: DataFrame, code: np.ndarray, length: np.ndarray) -> DataFrame:
    """Blocks of coded ids, with a bit offset every ``CHECKPOINT`` tokens."""
    tables = tokens.sparkSession.sparkContext.broadcast((code, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = tables.value
        names = ["doc_id", "block", "n_tokens", "n_bits", "checkpoints", "code"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, cell in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.frombuffer(cell, "<u2")
                    for b in range(0, len(ids), BLOCK_TOKENS):
                        some = ids[b : b + BLOCK_TOKENS]
                        data, offset = pack(some, code, length)
                        rows.append((doc_id, b // BLOCK_TOKENS, len(some), int(offset[-1]), offset[:-1:CHECKPOINT], data))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return tokens.mapInArrow(run, BLOCKS)


def decode_runs(data: bytes, at: np.ndarray, size: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ids of runs of at most ``CHECKPOINT`` tokens, one after the other: ``at`` are the
    runs' bit offsets, ``size`` their tokens; all are decoded in step."""
    ids, bits = table
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    by = np.argsort(-size, kind="stable")
    p = at[by]
    # how many runs, the longest first, still have a token k
    live = np.searchsorted(-size[by], -np.arange(CHECKPOINT), "left")
    out = np.zeros((CHECKPOINT, len(at)), np.uint16)
    for k, n in enumerate(live):
        if not n:
            break
        look = (window[p[:n] >> 3] >> (32 - limit - (p[:n] & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[k, :n] = ids[look]
        p[:n] += bits[look]
    back = np.empty(len(at), np.int64)
    back[by] = np.arange(len(at))
    return out.T[back][np.arange(CHECKPOINT) < size[:, None]]


def _run_sizes(n_tokens: int, runs: int) -> np.ndarray:
    return np.minimum(CHECKPOINT, n_tokens - CHECKPOINT * np.arange(runs))


def decode(data: bytes, n_tokens: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ids of a block."""
    return decode_runs(data, np.array(checkpoints, np.int64), _run_sizes(n_tokens, len(checkpoints)), table, limit)


def decode_blocks(result: DataFrame) -> DataFrame:
    """(doc_id, block, ids): the 16-bit ids of each block, as bytes, from rows of ``token_output`` alone."""
    lengths = result.filter("lengths IS NOT NULL").select(F.inline("lengths")).toArrow()
    bits = lengths.column("bits").to_numpy().astype(np.int64)
    limit = int(bits.max()) if len(bits) else LIMIT
    table = decode_table(*canonical(lengths.column("id").to_numpy(), bits), limit)
    known = result.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "code"):
            codes, n, points = (batch.column(k).to_pylist() for k in ("code", "n_tokens", "checkpoints"))
            base = np.cumsum([0, *map(len, codes)])[:-1]
            at = np.concatenate([np.array(c, np.int64) + 8 * b for c, b in zip(points, base)])
            size = np.concatenate([_run_sizes(k, len(c)) for k, c in zip(n, points)])
            ids = decode_runs(b"".join(codes), at, size, known.value, limit)
            first = 2 * np.cumsum([0, *n])
            cells = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), cells.cast(pa.binary())], ["doc_id", "block", "ids"])

    blocks = result.filter("lengths IS NULL").select("doc_id", "block", "n_tokens", "checkpoints", "code")
    return blocks.mapInArrow(run, "doc_id long, block int, ids binary")


def _digest(blocks: DataFrame) -> tuple:
    """How many (doc_id, block, ids) there are, and the sum of their hashes."""
    h = F.xxhash64("doc_id", "block", "ids").cast("decimal(20,0)")
    return tuple(blocks.agg(F.count("*"), F.sum(h)).first())


def check_blocks(result: DataFrame, tokens: DataFrame) -> None:
    """Decode the rows of ``token_output`` and hold them against the ids of all documents."""
    size = 2 * BLOCK_TOKENS
    parts = F.expr(f"transform(sequence(0, CAST((length(ids) - 1) div {size} AS INT)), k -> substring(ids, k * {size} + 1, {size}))")
    want = tokens.select("doc_id", F.posexplode(parts).alias("block", "ids"))
    if _digest(decode_blocks(result)) != _digest(want):
        raise RuntimeError("the blocks don't decode to the ids they were made from")


def code_table(tokens: DataFrame, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that occur, how often, and their code lengths; one row per id of the vocabulary at most."""
    table = counts(tokens).orderBy("id").toArrow()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    return ids, n, code_lengths(n, limit)


def build_code(tokens: DataFrame, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code of all ids that occur."""
    ids, _, bits = code_table(tokens, limit)
    return canonical(ids, bits)


def token_output(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """The blocks of all documents, and a row with the code lengths."""
    spark = docs.sparkSession
    tokens = persist(token_ids(docs, vocabulary), "ids")
    ids, n, bits = code_table(tokens, limit)
    lengths = list(zip(ids.tolist(), n.tolist(), bits.tolist()))
    code = spark.createDataFrame([(None, -1, 0, 0, [], b"", lengths)] if lengths else [], RESULT).coalesce(1)
    blocks = encode_blocks(tokens, *canonical(ids, bits))
    result = persist(code.unionByName(blocks, allowMissingColumns=True), "blocks")
    check_blocks(result, tokens)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents as coded blocks, with their code."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
