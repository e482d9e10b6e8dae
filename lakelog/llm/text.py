"""Words of whole texts, found and hashed with numpy over Arrow buffers.

A word is a maximal run of ASCII digits, ASCII letters and characters from
U+0080 up, in lower case.  The same words in SQL::

    list_filter(string_split_regex(lower(text), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda w: w <> '')
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SQL_SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_VALUE = (np.arange(256, dtype=np.uint64) * U(0xBF58476D1CE4E5B9) + U(0x94D049BB133111EB)).astype(np.uint64)
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in " \n\t\r"]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Texts are worked on in pieces of about so many bytes (never less than one text), to bound memory.
CHUNK_BYTES = 1 << 20


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, 0 to n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES * 2)
        for k, p in enumerate((_P, _PINV)):
            base = np.full(m, p, dtype=np.uint64)
            base[0] = 1
            _powers[k] = np.cumprod(base, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of a few texts: ``starts``/``ends`` are byte offsets into ``buf``,
    ``first[i]:first[i+1]`` are the words of text i, ``hashes`` their 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        off = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        data = low.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(low) else np.zeros(0, np.uint8)
        self.buf, self.off = buf, off - off[0] if len(off) else np.zeros(1, np.int64)
        is_word = _WORD[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = is_word[:-1]
        inner = self.off[:-1]
        before[inner[inner < len(buf)]] = False
        self.starts = np.flatnonzero(is_word & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = is_word[1:]
        last = self.off[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, self._inverse = power_tables(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.buf] * power[:n], dtype=np.uint64, out=self._total[1:])
        return self.pieces(self.starts, self.ends)

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of pieces of ``buf`` (equal pieces have equal hashes); there must be words."""
        h = (self._total[ends] - self._total[starts]) * self._inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))

    def sentence_ends(self) -> np.ndarray:
        """Whether each word ends a sentence: a line or the text ends behind it, or . ! or ? and white space follow."""
        n, buf = len(self.starts), self.buf
        stop = _END[buf]
        stop[:-1] &= _BLANK[buf[1:]]
        stop |= buf == 10
        seen = np.concatenate([[0], np.cumsum(stop)])
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = seen[self.starts[1:]] > seen[self.ends[:-1]]
            ends[self.first[1:][np.diff(self.first) > 0] - 1] = True
        return ends

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and, per text, the first of its runs.  A text of
        1 to n-1 words has one run, of all its words."""
        count = np.diff(self.first)
        runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        if not first[-1]:
            return np.zeros(0, np.uint64), first
        at = np.repeat(self.first[:-1] - first[:-1], runs) + np.arange(first[-1])
        end = np.repeat(self.first[1:], runs)
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        h = np.full(len(at), 0x51ED270B, np.uint64)
        for j in range(n):
            h = h * U(_P) + np.where(at + j < end, padded[at + j], U(0))
        return mix(h), first

    def char_offsets(self, byte_offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Character offsets within their texts, of byte offsets into ``buf``."""
        lead = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        return lead[byte_offsets] - lead[self.off[text]]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text each, at least a row."""
    most = most or CHUNK_BYTES
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def longs(h: np.ndarray) -> pa.Array:
    """Hashes as signed 64-bit Arrow values."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
