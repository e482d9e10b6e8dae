"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks.

A page is read into its leaf blocks, the texts between block-level tags, in order.  Each
has features of its text and of its ancestors: their different tags and classes, innermost
first, as far as ``WIDTH`` features reach.  A two-tag CRF (content or not) over the blocks of
a page is trained on labelled pages and decoded by Viterbi.

Labelled pages are a bounded sample of ``max_pages`` pages, those of least hash: the blocks
of a page that are lines of the one document which shares the most with it are its content
(distant supervision from ``documents``).  Shared lines weigh by their inverse document
frequency; documents with the same lines of the sample, as copies, count as one.  The sample's
lines are broadcast up to ``BROADCAST_LINES``, and joined by shuffle beyond that.

Defined cases: null, empty and tagless html are pages without, or with one, block; broken
markup never fails: an unclosed comment, script or tag ends the page, end tags without a
start are ignored; text is cut into blocks in one pass and ancestors are kept as shared
tuples of bounded length, so long and deep pages take linear time;
null page_ids and repeated rows pass, each row for itself; without labelled pages nothing
is content; only page_id and html, and doc_id and text of the documents, are read.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelog.llm.crf import Crf
from lakelog.llm.storage import persist
from lakelog.llm.text import chunks

MAX_PAGES = 600
FEATURES = 1 << 14
WIDTH = 32
#: Different ancestors' tags, and classes, of a block that can be features.
TAGS, CLASSES = 15, 8
BROADCAST_LINES = 200_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*["']?([\w-]+)""")
_BLANKS = re.compile(r"\s+")
_RAW = {"script", "style", "template", "noscript", "textarea", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "em", "font", "i", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
_SELF_CLOSING = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}

OUT = "page_id long, n_blocks int, n_content int, text string"


class Block:
    __slots__ = ("text", "tags", "classes", "linked")

    def __init__(self, text: str, tags: tuple[str, ...], classes: tuple[str, ...], linked: int):
        self.text, self.tags, self.classes, self.linked = text, tags, classes, linked


def _with(near: tuple[str, ...], name: str, most: int) -> tuple[str, ...]:
    """``name`` before the other ones of ``near``."""
    return (name, *[x for x in near if x != name])[:most] if name else near


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; blank ones are left out."""
    out: list[Block] = []
    # open tags: name, and the different tags and classes from here outwards
    stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [("", (), ())]
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def push(tag: str, name: str = "") -> None:
        _, tags, classes = stack[-1]
        stack.append((tag, tags if tag in _INLINE else _with(tags, tag, TAGS), _with(classes, name, CLASSES)))
        open_[tag] = open_.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANKS.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, *stack[-1][1:], linked))
            parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            parts.append(page[at:i])
            if open_.get("a"):
                linked += i - at
        if i == n:
            break
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        m = _TAG.match(page, i)
        if not m:
            if page.find(">", i) < 0:
                break
            if page.startswith(("<!", "<?"), i):
                at = page.find(">", i) + 1
            else:
                parts.append("<")
                at = i + 1
            continue
        at = m.end()
        close, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        if tag in _RAW and not close:
            m = _END[tag].search(page, at)
            at = m.end() if m else n
        elif tag == "br":
            parts.append(" ")
        elif tag in _VOID:
            continue
        elif tag in _INLINE:
            if not close:
                push(tag)
            elif stack[-1][0] == tag:
                pop()
        else:
            flush()
            while stack[-1][0] in _INLINE:
                pop()
            if close:
                if open_.get(tag):
                    while pop() != tag:
                        pass
            else:
                if stack[-1][0] == "p" or stack[-1][0] == tag and tag in _SELF_CLOSING:
                    pop()
                if not rest.endswith("/"):
                    found = _CLASS.search(rest)
                    push(tag, found.group(1).lower() if found else "")
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _index(name: str) -> int:
    return zlib.crc32(name.encode()) % (FEATURES - 1) + 1


def features(page: list[Block]) -> np.ndarray:
    """Indices of each block's features; 0 where it has fewer than ``WIDTH``."""
    out = np.zeros((len(page), WIDTH), np.int64)
    before = ""
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        parent = b.tags[0] if b.tags else "-"
        names = [
            f"parent {parent}",
            f"before {before}",
            f"words {min(words, 64).bit_length()}",
            f"chars {min(len(b.text), 4096).bit_length()}",
            f"linked {min(4, 4 * b.linked // max(len(b.text), 1))}",
            f"end {b.text[-1] if b.text[-1] in '.!?:;,' else '-'}",
            f"mark {any(c in b.text for c in '©|»·')}",
            f"commas {min(b.text.count(','), 3)}",
            f"place {10 * k // len(page)}",
            *[f"within {t}" for t in b.tags],
            *[f"class {c}" for c in b.classes],
        ]
        out[k, : min(len(names), WIDTH)] = [_index(x) for x in names[:WIDTH]]
        before = parent
    return out


def labelled_pages(pages: DataFrame, docs: DataFrame, max_pages: int = MAX_PAGES) -> list[tuple[str, np.ndarray]]:
    """(html, tag of each block) of at most ``max_pages`` pages that share lines with a document."""
    spark = pages.sparkSession
    order = [F.xxhash64("page_id"), F.col("page_id")]
    usable = pages.select("page_id", "html").filter("page_id IS NOT NULL AND html IS NOT NULL")
    # ids first: pages themselves aren't sorted
    ids = usable.select("page_id").distinct().orderBy(*order).limit(max_pages)
    picked = usable.join(F.broadcast(ids), "page_id").orderBy(*order, F.xxhash64("html")).limit(max_pages).toArrow()
    texts = picked.column("html").to_pylist()
    rows = [(p, k, b.text) for p, x in enumerate(texts) for k, b in enumerate(blocks(x))]
    schema = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("line", T.StringType())])
    sample = spark.createDataFrame(rows, schema).select("page", "block", F.xxhash64("line").alias("h"))
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "t", F.xxhash64(F.trim("line")).alias("h"))
    few = len(rows) <= BROADCAST_LINES
    at_hand = F.broadcast if few else (lambda df: df)
    hits = lines.join(at_hand(sample.select("h").distinct()), "h", "left_semi")
    # documents with the same lines of the sample give the same labels
    of_text = hits.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("h")).alias("lines"))
    sets = persist(of_text.groupBy("lines").agg(F.min("doc_id").alias("doc_id")), "sets").withColumn("set", F.xxhash64("lines"))
    shared = sets.select("set", "doc_id", F.explode("lines").alias("h"))
    # whole numbers, so that sums don't depend on their order
    weight = F.round(F.log(1 + F.lit(float(sets.count())) / F.count("*")) * 1e6).cast("long")
    votes = shared.join(at_hand(shared.groupBy("h").agg(weight.alias("w"))), "h").join(at_hand(sample), "h").groupBy("page", "set", "doc_id").agg(F.sum("w").alias("w"))
    best = votes.groupBy("page").agg(F.max_by("set", F.struct("w", -F.col("doc_id"), "set")).alias("set"))
    found = shared.join(F.broadcast(best), "set").join(at_hand(sample), ["page", "h"]).select("page", "block").distinct().toArrow()
    of: dict[int, list[int]] = {}
    for p, k in zip(found.column("page").to_pylist(), found.column("block").to_pylist()):
        of.setdefault(p, []).append(k)
    out = []
    for p, x in enumerate(texts):
        if p in of:
            tags = np.zeros(len(blocks(x)), np.int64)
            tags[of[p]] = 1
            out.append((x, tags))
    return out


def train(labelled: list[tuple[str, np.ndarray]], epochs: int = 40) -> Crf | None:
    """A CRF from pages and the tags of their blocks; None without content."""
    parsed = [features(blocks(x)) for x, _ in labelled]
    if not parsed or not any(t.any() for _, t in labelled):
        return None
    first = np.concatenate([[0], np.cumsum([len(f) for f in parsed])])
    return Crf(FEATURES).fit(np.concatenate(parsed), np.concatenate([t for _, t in labelled]), first, epochs=epochs)


def extract(pages: DataFrame, crf: Crf | None) -> DataFrame:
    """page_id, the numbers of blocks and of content blocks, and the content, a line each."""
    model = pages.sparkSession.sparkContext.broadcast(crf and (crf.weights, crf.bias, crf.start, crf.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Crf(FEATURES)
        if model.value:
            tagger.weights, tagger.bias, tagger.start, tagger.move = model.value
        for batch in chunks(batches, "html"):
            pages = [blocks(x or "") for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
            emit = tagger.emissions(np.concatenate([np.zeros((0, WIDTH), np.int64), *[features(p) for p in pages]]))
            tags = tagger.viterbi(emit, first) if model.value else np.zeros(len(emit), np.int8)
            texts = ["\n".join(b.text for b, t in zip(p, tags[a:]) if t) for p, a in zip(pages, first)]
            content = np.add.reduceat(np.append(tags, 0), first[:-1]) * (np.diff(first) > 0) if len(pages) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int32()), pa.array(content, pa.int32()), pa.array(texts, pa.string())], ["page_id", "n_blocks", "n_content", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the main text of all pages."""
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    return extract(pages, train(labelled_pages(pages, docs)))
