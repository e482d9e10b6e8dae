"""Information-theoretic sanitisation of personal data and secrets.

Protected entities are e-mail addresses, telephone, card and IP numbers, keys and secrets,
found by their form.  An entity reveals itself completely and is always replaced by its
class.  Telephone numbers have +, (, - or groups divided by blanks or dots; of the latter
decimals, years, dates and amounts with thousands (of at most 8 digits, or round) are left.
Other words reveal it as far as the corpus says: with n documents, n_c of them with
the entity c, n_t with the word t, and n_ct with t within ``WINDOW`` words of c,

    disclosure(t, c) = PMI(c; t) / IC(c) = log(n_ct n / (n_c n_t)) / log(n / n_c)

which is 1 if t always means c and about 0 if it says nothing.  Near are the ``WINDOW``
words before and after an entity that belong to no entity themselves, however far away.
All four counts are of different texts, so that copies and repeated rows count once.  A
pair must be seen in ``SUPPORT`` different contexts to be estimated at all.  In documents
with c, words with a disclosure of ``GENERALISE`` or more become ``<TERM>``, of ``REMOVE``
or more are removed.

All counts are over all documents: one scan finds entities and the words near them, one
counts the texts of the words that may be revealing, one rewrites.  The revealing pairs
are broadcast up to ``BROADCAST_PAIRS`` and a number of bytes, and joined to their
documents beyond that.

Defined cases: null texts stay null and empty ones empty; a document without entities comes
out unchanged; words are compared in lower case, character by character, and replaced where
they stand in the text itself, also where lower case would be longer (as of "İ"); null doc_ids and repeated rows pass, each row for itself; an entity that
every document has has no information and reveals nothing but itself; only doc_id and text
are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.llm.storage import persist, small
from lakelog.llm.text import U, Words, chunks

WINDOW = 10
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.8
BROADCAST_PAIRS = 100_000
BITS = 24
TEXT_BITS = 26

#: What every entity has some of: a text without it is passed over, with it all patterns decide.
_HINT = re.compile(r"[\d@=:]|A[KS]IA|[a-f]{32}")
_MAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[\w.+%-]+")
_NUMBER = re.compile(r"(?<![\w.])\+?\(?\d[\d ().\-]{5,}\d(?!\w)")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_SOLID = re.compile(rf"(?<![\d.]){_IP.pattern}(?![\d.]*\d)|(?<!\d)\d{{13,19}}(?!\d)")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_GROUPS = re.compile(r"\d{1,5}(?:(?: {1,2}|\.)\d{2,9})+")
#: Numbers in groups that are no telephone numbers: decimals, years, dates, amounts.
_PLAIN = re.compile(
    r"(?:0|[1-9]\d*)\.\d+(?: {1,2}(?:0|[1-9]\d*)\.\d+)*"
    r"|(?:19|20)\d\d(?: {1,2}(?:19|20)\d\d)+"
    r"|\d{1,2}([ .])\d{1,2}\1(?:19|20)\d\d|(?:19|20)\d\d([ .])\d\d\2\d\d"
    r"|[1-9]\d?([ .])\d{3}\3\d{3}|[1-9]\d{0,2}(?:[ .]\d{3})*(?:[ .]000){2}"
)
_KEY = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b[0-9a-f]{32,}\b")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{6,})[\"']?")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")

OUT = "doc_id long, text string, n_entities int, n_generalised int, n_removed int"


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the entities of a text, in order, without overlaps."""
    if not _HINT.search(text):
        return []
    found = []
    if "@" in text:
        for m in _MAIL.finditer(text):
            # what stands before the sign, backwards as far as the sign before
            local = _LOCAL.match(text[text.rfind("@", 0, m.start()) + 1 : m.start()][::-1])
            if local:
                found.append((m.start() - local.end(), m.end(), "EMAIL"))
    for m in _SECRET.finditer(text):
        found.append((m.start(1), m.end(1), "SECRET"))
    for m in _KEY.finditer(text):
        found.append((m.start(), m.end(), "SECRET"))
    for m in _NUMBER.finditer(text):
        found += [(m.start() + a, m.start() + b, c) for a, b, c in _numbers(m.group())]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _numbers(s: str) -> list[tuple[int, int, str]]:
    """What a run of digits and separators holds: it may be several numbers with blanks between."""
    out, at = [], 0
    for m in _SOLID.finditer(s):
        out += [*_spaced(s, at, m.start()), (m.start(), m.end(), "IP" if "." in m.group() else "CARD")]
        at = m.end()
    return out + _spaced(s, at, len(s))


def _spaced(s: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """A card or telephone number written in groups, within s[a:b]."""
    part = s[a:b].strip(" .-")
    if not part:
        return []
    a = s.index(part, a)
    digits = sum(c.isdigit() for c in part)
    if 13 <= digits <= 19 and re.sub(r"[ -]", "", part).isdigit():
        return [(a, a + len(part), "CARD")]
    if 7 <= digits <= 15:
        marked = any(c in part for c in "+(-") and not _DATE.fullmatch(part)
        if marked or (_GROUPS.fullmatch(part) and not _PLAIN.fullmatch(part)):
            return [(a, a + len(part), "PHONE")]
    return [x for m, n in _cut(part, digits) for x in _spaced(s, a + m, a + n)]


def _cut(part: str, digits: int) -> list[tuple[int, int]]:
    """Where to look in what isn't one number: between sentence ends; of too many digits, groups that repeat, or each."""
    pieces = [m.span() for m in re.finditer(r"(?:[^.]|\.(?! ))+", part)]
    if len(pieces) > 1 or digits <= 15:
        return pieces if len(pieces) > 1 else []
    pieces = [m.span() for m in re.finditer(r"\S+", part)]
    sizes = [sum(c.isdigit() for c in part[x:y]) for x, y in pieces]
    n = len(pieces)
    for k in range(1, n):
        if n % k == 0 and sizes == sizes[:k] * (n // k) and 7 <= sum(sizes[:k]) <= 15:
            return [(pieces[i][0], pieces[i + k - 1][1]) for i in range(0, n, k)]
    return pieces if n > 1 else []


def _id(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode()) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _fold(word: str) -> str:
    """A word in lower case, character by character, as ``Words`` has it."""
    return word.lower() if word.isascii() else pc.utf8_lower(pa.scalar(word)).as_py()


def _terms(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words that touch no entity."""
    ends = [b for _, b, _ in spans]
    out = []
    for m in _WORD.finditer(text):
        k = bisect_left(ends, m.start() + 1)
        if k == len(spans) or spans[k][0] >= m.end():
            out.append((m.start(), m.end(), _fold(m.group())))
    return out


def _near(text: str, spans: list[tuple[int, int, str]], window: int) -> list[list[str]]:
    """For each entity the words within the window."""
    terms = _terms(text, spans)
    starts = [a for a, _, _ in terms]
    at = [bisect_left(starts, a) for a, _, _ in spans]
    return [[w for _, _, w in terms[max(0, k - window) : k + window]] for k in at]


def _text_hash() -> Column:
    return F.xxhash64("text")


def near_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(th, entity, context, word): the words near each entity of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows: list[tuple[int, int, int, str]] = []
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = entities(text or "")
                if spans:
                    for (a, b, _), words in zip(spans, _near(text, spans, window)):
                        entity, context = _id(text[a:b].lower()), _id(" ".join(words))
                        rows += [(th, entity, context, w) for w in set(words)] or [(th, entity, context, "")]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["th", "entity", "context", "word"])

    return docs.select(_text_hash().alias("th"), "text").mapInArrow(run, "th long, entity long, context long, word string")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The lower bits of the column h, of fixed size; never more than 2**(bits - 6) rows reach the driver."""
    mask = (1 << bits) - 1
    at = F.shiftright(F.col("h").bitwiseAND(F.lit(mask)), 6)
    table = hashes.groupBy(at.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(h & {mask} & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def word_texts(docs: DataFrame, words: DataFrame, copied: DataFrame) -> DataFrame:
    """(word, n_t): how many different texts have each of the words; all are counted.
    ``copied``: hashes h of the texts that occur more than once.  Bitmaps of fixed size thin
    out: rows that may be copies are told apart by their text's hash, others are counted at once."""
    keyed = _hashed(words)
    known = docs.sparkSession.sparkContext.broadcast((_bitmap(keyed, BITS), _bitmap(copied, TEXT_BITS)))

    def has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        p = (h & U(8 * len(table) - 1)).astype(np.int64)
        return (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def rows(h, th, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(th, pa.int64()), pa.array(n, pa.int64())], ["h", "th", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        seen, copies = known.value
        for batch in chunks(batches):
            words = Words(batch.column(1))
            th = batch.column(0).to_numpy()
            hit = np.flatnonzero(has(seen, words.hashes))
            of, h = words.text_of()[hit], words.hashes[hit]
            by = np.lexsort((of, h))
            of, h = of[by], h[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            of, h = of[new], h[new].view(np.int64)
            again = has(copies, th.view(np.uint64))[of]
            if again.any():
                yield rows(h[again], th[of[again]], np.ones(again.sum(), np.int64))
            for k, c in zip(*(x.tolist() for x in np.unique(h[~again], return_counts=True))):
                total[k] = total.get(k, 0) + c
            if len(total) > 1_000_000:
                yield rows(list(total), [None] * len(total), list(total.values()))
                total = {}
        yield rows(list(total), [None] * len(total), list(total.values()))

    found = docs.select(_text_hash().alias("th"), "text").mapInArrow(run, "h long, th long, n long")
    each = found.groupBy("h", "th").agg(F.sum("n").alias("n"))
    counted = each.groupBy("h").agg(F.sum(F.when(F.col("th").isNull(), F.col("n")).otherwise(1)).alias("n_t"))
    return keyed.join(counted, "h").select("word", "n_t")


def _hashed(words: DataFrame) -> DataFrame:
    """(word, h): words with the hash that scans give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = Words(batch.column(0))
                one = np.diff(words.first) == 1
                part = batch.filter(pa.array(one))
                h = words.hashes[words.first[:-1][one]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h.view(np.int64))], ["word", "h"])

    return words.select("word").mapInArrow(run, "word string, h long")


def disclosures(docs: DataFrame, near: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, word, disclosure) of the pairs that reach ``least``."""
    texts = persist(docs.groupBy(_text_hash().alias("h")).count(), "texts")
    n = texts.count()
    pairs = near.filter("word <> ''").groupBy("entity", "word").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("th").alias("n_ct"))
    pairs = persist(pairs.filter(F.col("contexts") >= support), "pairs")
    n_c = near.groupBy("entity").agg(F.count_distinct("th").alias("n_c"))
    counted = pairs.join(n_c, "entity").join(word_texts(docs, pairs.select("word").distinct(), texts.filter("count > 1")), "word")
    value = F.log(F.col("n_ct") * F.lit(float(n)) / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_c"))
    return counted.filter(F.col("n_c") < n).select("entity", "word", value.alias("disclosure")).filter(F.col("disclosure") >= least)


def rewrite(text: str, spans: list[tuple[int, int, str]], terms: dict[str, float], remove: float) -> tuple[str, int, int]:
    """The text with entities replaced, and revealing terms generalised or removed; how many of both."""
    edits = [(a, b, f"<{c}>") for a, b, c in spans]
    if terms:
        edits += [(a, b, "" if terms[w] >= remove else "<TERM>") for a, b, w in _terms(text, spans) if w in terms]
        edits.sort()
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    general, gone = (sum(new == kind for _, _, new in edits) for kind in ("<TERM>", ""))
    return "".join([*out, text[at:]]), general, gone


def sanitize(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, the sanitised text, and how many entities, generalised and removed terms it had."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    near = persist(near_words(docs, window), "near")
    found = persist(disclosures(docs, near, support, generalise), "disclosures")
    if small(found, BROADCAST_PAIRS, F.octet_length("word") + 16):
        table: dict[int, dict[str, float]] = {}
        for r in found.collect():
            table.setdefault(r.entity, {})[r.word] = r.disclosure
        known = spark.sparkContext.broadcast(table)
        rows = docs.withColumn("terms", F.lit(None).cast("map<string,double>"))
    else:
        known = spark.sparkContext.broadcast({})
        per = near.select("th", "entity").distinct().join(found, "entity").groupBy("th", "word").agg(F.max("disclosure").alias("d"))
        per = per.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("word", "d"))).alias("terms"))
        rows = docs.withColumn("th", _text_hash()).join(per, "th", "left").select("doc_id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc_id, text, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                spans = entities(text or "")
                if not spans:
                    rows.append((doc_id, text, 0, 0, 0))
                    continue
                terms: dict[str, float] = dict(own or [])
                for a, b, _ in spans:
                    for word, d in known.value.get(_id(text[a:b].lower()), {}).items():
                        terms[word] = max(d, terms.get(word, d))
                new, general, gone = rewrite(text, spans, terms, remove)
                rows.append((doc_id, new, len(spans), general, gone))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "text", "n_entities", "n_generalised", "n_removed"])

    return rows.select("doc_id", "text", "terms").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, sanitised."""
    return sanitize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
