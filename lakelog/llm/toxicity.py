"""Toxic spans by a linear-chain CRF over the words of sentences.

Training: a bounded sample of labelled documents (``max_toxic`` and ``max_clean``, those
of least hash) is read to the driver.  Tokens get labels from the documents': a word, or
an opening of 4 to 8 bytes of words, counts as a toxic term if the documents of the sample
that have it are toxic so often that chance would do it with a probability under
``chance``, and if it comes with different neighbours (the words of a much copied document
don't); a term's words in toxic documents are the positive tokens.  The CRF learns from
these with hashed features (word, openings, ending), so that it also knows inflected forms.

Scoring: one scan, forward-backward over every sentence of every document.  A document's
score is the largest marginal of its words; documents that reach ``threshold`` are
reported with the spans of words that do, in character offsets of the text.

Defined cases: null and empty texts score 0 and are not reported; labels that are null, that
contradict each other or that have no document are ignored; of a sampled document that comes
in many rows, the sample takes no more than twice ``max_toxic + max_clean`` rows in all; without any toxic label in the sample nothing is reported;
rows with a null doc_id are reported with it; repeated rows are reported as often as they
come; only doc_id, text, and doc_id, toxic of the labels are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.crf import Crf
from lakelog.llm.text import U, Words, chunks, mix

MAX_TOXIC = 800
MAX_CLEAN = 2400
CHANCE = 1e-6
THRESHOLD = 0.5
FEATURES = 1 << 18
_OPENINGS = (4, 5, 6, 7, 8)
_KINDS = 2 + len(_OPENINGS)

SPANS = "doc_id long, score double, n_toxic int, spans array<struct<start:int,end:int>>"


def unit_hashes(words: Words) -> np.ndarray:
    """64-bit features of each word, one column a kind; 0 where the word is too short for it."""
    n = len(words.starts)
    out = np.zeros((n, _KINDS), np.uint64)
    if not n:
        return out
    length = words.ends - words.starts
    out[:, 0] = words.hashes
    for k, m in enumerate(_OPENINGS, 1):
        long = np.flatnonzero(length >= m)
        out[long, k] = words.pieces(words.starts[long], words.starts[long] + m) * U(2 * k + 1)
    long = np.flatnonzero(length >= 3)
    out[long, -1] = words.pieces(words.ends[long] - 3, words.ends[long]) * U(0x5BD1E995)
    return out


def feature_index(units: np.ndarray, n: int = FEATURES) -> np.ndarray:
    """Units as indices below n; 0 stays 0."""
    return np.where(units == 0, 0, (units >> U(20)) % U(n - 1) + U(1)).astype(np.int32)


def sentences(words: Words) -> np.ndarray:
    """Offsets of the chains: sentences, within texts."""
    return np.concatenate([[0], np.flatnonzero(words.sentence_ends()) + 1])


def neighbours(words: Words) -> np.ndarray:
    """A hash of the words before and behind each word."""
    h = np.concatenate([np.zeros(1, np.uint64), words.hashes, np.zeros(1, np.uint64)])
    return (mix(h[:-2] * U(0x9E3779B97F4A7C15) + h[2:]) >> U(33)).astype(np.int32)


def term_tags(units: np.ndarray, of: np.ndarray, toxic: np.ndarray, near: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """Token labels from the texts' labels.  ``units``: an index per token and kind, 0 where
    absent; ``of``: the text of each token; ``near``: its neighbours."""
    prior = toxic.mean() if len(toxic) else 0.0
    tags = np.zeros(len(of), bool)
    if not 0 < prior < 1:
        return tags
    for k in range(units.shape[1] - 1):  # endings alone don't make a term
        found, unit = np.unique(units[:, k], return_inverse=True)
        size = len(found)
        pair = np.unique(unit * np.int64(len(toxic)) + of)
        u, d = pair // len(toxic), pair % len(toxic)
        bad = np.bincount(u, weights=toxic[d], minlength=size)
        total = np.bincount(u, minlength=size)
        good = total - bad
        contexts = np.bincount(np.unique((unit.astype(np.int64) << 32) + near) >> 32, minlength=size)
        # log of how much likelier so many toxic documents are by the term than by chance
        own = np.where((bad > 0) & (good > 0), bad * np.log(np.maximum(bad, 1) / np.maximum(total, 1)) + good * np.log(np.maximum(good, 1) / np.maximum(total, 1)), 0.0)
        term = (bad * math.log(prior) + good * math.log(1 - prior) - own < math.log(chance)) & (bad >= 0.9 * total) & (contexts >= 0.5 * total)
        term &= found > 0
        tags |= term[unit]
    return tags & toxic[of].astype(bool)


def train(texts: pa.Array, toxic: np.ndarray, chance: float = CHANCE, epochs: int = 40) -> Crf | None:
    """A CRF from texts with labels 0 and 1; None if no term stands out.  Texts are read in
    pieces, so that the driver holds 36 bytes a token."""
    units, of, near, first, tokens = [np.zeros((_KINDS, 0), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    at = 0
    for batch in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        words = Words(batch.column(0))
        units.append(np.ascontiguousarray(feature_index(unit_hashes(words), 1 << 24).T))
        of.append((words.text_of() + at).astype(np.int32))
        near.append(neighbours(words))
        first.append(sentences(words)[1:] + tokens)
        at, tokens = at + batch.num_rows, tokens + len(words.starts)
    every = np.concatenate(units, axis=1).T  # a column of it lies in one piece
    units.clear()
    tags = term_tags(every, np.concatenate(of), toxic, np.concatenate(near), chance)
    of.clear()
    near.clear()
    if not tags.any():
        return None
    return Crf(FEATURES).fit(narrow(every), tags.astype(np.int64), np.concatenate(first), epochs=epochs)


def narrow(units: np.ndarray) -> np.ndarray:
    """Indices below 2**24 as indices of weights, in place."""
    units[units > 0] = units[units > 0] % (FEATURES - 1) + 1
    return units


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most so many documents; of each class those of least hash of their id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.filter("toxic = most").drop("most")
    pick = lambda t, n: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = pick(1, max_toxic).unionByName(pick(0, max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    table = rows.limit(2 * (max_toxic + max_clean)).select("text", "toxic").toArrow()
    return table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(np.int64)


def toxic_spans(docs: DataFrame, crf: Crf | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, n_toxic and spans of the documents that reach the threshold."""
    spark = docs.sparkSession
    if crf is None:
        return spark.createDataFrame([], SPANS)
    model = spark.sparkContext.broadcast((crf.weights.astype(np.float32), crf.bias, crf.start, crf.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Crf(1)
        scorer.weights, scorer.bias, scorer.start, scorer.move = model.value
        for batch in chunks(batches, most=2 << 20):
            words = Words(batch.column(1))
            if not len(words.starts):
                continue
            p = scorer.marginals(scorer.emissions(narrow(feature_index(unit_hashes(words), 1 << 24))), sentences(words))
            hit = np.flatnonzero(p >= threshold)
            if not len(hit):
                continue
            doc = words.text_of()[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) > 1) | (np.diff(doc) > 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(hit)) - 1
            start = words.char_offsets(words.starts[hit[head]], doc[head])
            end = words.char_offsets(words.ends[hit[tail]], doc[head])
            d = np.unique(doc)
            top = np.maximum.reduceat(p[hit], np.searchsorted(doc, d))
            count = np.bincount(doc)[d]
            first = np.append(np.searchsorted(doc[head], d), len(head))
            span = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), span)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(top), pa.array(count, pa.int32()), spans], ["doc_id", "score", "n_toxic", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPANS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: toxic documents and spans of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxic_spans(docs, train(*sample(docs, labels)))
