"""Nulls, empty and long texts, ties, repeated rows, empty tables, further columns of clashing names."""

import pytest

from lakelog.llm import decontaminate, html_extract, jaccard_join, line_dedup, packing, quality, sanitize, token_output, toxicity, warc

LONG = " ".join(f"word{i % 977} and" for i in range(60_000)) + ".\n" + "one long line again " * 5
COPY = "a text of some words that comes twice with the very same words in it, and ends here."
ROWS = [
    (1, COPY), (2, COPY), (2, COPY), (3, None), (None, COPY), (None, None), (4, ""), (5, "   \n\n  "), (6, LONG), (7, "x"), (8, "İstanbul ß 😀 é́   \x00 tail"), (-9, "call a.b@c.example now. It's fine!\nIt's fine!"), (9, COPY.upper()),
]
EXTRA = "doc_id long, text string, h1 string, h2 string, fp string, size string, label string, terms string, `list` string, seed string, lines string, __id string, __drops string, n_words string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x"] * 12, 1) for i, t in ROWS], EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, COPY, "x"), (1, COPY, "x"), (2, None, "x"), (None, COPY, "x"), (3, "", "x"), (4, "two words", "x")], "item_id long, text string, seed string")


def test_quality(docs, none):
    kept = quality.keep_good(docs.select("doc_id", "text", "fp", "n_words"))
    assert kept.columns == ["doc_id", "text", "fp", "n_words"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert (False, 1) in ids and (True, 0) in ids and (False, 3) not in ids and (False, 4) not in ids
    every = quality.quality_rules(docs, keep_only=False)
    assert every.count() == len(ROWS) and every.filter("doc_id = 3").first().broken == "length,words"
    assert quality.quality_rules(none).count() == 0


def test_line_dedup(docs, none):
    out = line_dedup.drop_seen_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    text = {}
    for r in out.collect():
        text.setdefault(r.doc_id, []).append(r.text)
    assert sorted(text[None], key=str) == [None, COPY]  # null ids come first
    assert text[1] == [""] and text[2] == ["", ""] and text[4] == [""] and text[3] == [None] and text[9] == [COPY.upper()]
    assert line_dedup.line_dedup(none).count() == 0


def test_decontaminate(docs, items, none):
    found = decontaminate.contaminated(docs, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 1), (9, 1)]
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "None", "None", "4", "5", "6", "7", "8", "-9"])
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, none.toDF("item_id", "text")).count() == 0


def test_token_output(docs, none):
    blocks = token_output.token_output(docs).collect()
    assert sorted(str(b.doc_id) for b in blocks if b.block == 0) == sorted(["1", "2", "2", "None", "5", "6", "7", "8", "-9", "9"])
    assert len([b for b in blocks if b.doc_id == 6]) > 1
    assert token_output.token_output(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "x"), (2, None, "x"), (None, 1, "x"), (77, 0, "x")], "doc_id long, toxic int, text string")
    texts, toxic = toxicity.sample(docs, labels)
    assert len(texts) == 1 and toxicity.train(texts, toxic) is None
    assert toxicity.toxic_spans(docs, None).count() == 0
    crf = toxicity.Crf(toxicity.FEATURES)
    crf.bias = 9.0  # every word
    rows = toxicity.toxic_spans(docs, crf).collect()
    assert len(rows) == 9 and all(s.start < s.end for r in rows for s in r.spans)
    assert toxicity.toxic_spans(none, crf).count() == 0 and toxicity.sample(none, labels)[1].size == 0


def test_html(spark, docs, none):
    pages = docs.toDF("page_id", "html", *docs.columns[2:])
    rows = html_extract.extract(pages, None).collect()
    assert len(rows) == len(ROWS) and all(r.text == "" and r.n_content == 0 for r in rows)
    labelled = html_extract.labelled_pages(pages, docs)
    assert labelled and html_extract.extract(pages, html_extract.train(labelled)).count() == len(ROWS)
    assert html_extract.extract(none.toDF("page_id", "html"), None).count() == 0
    assert html_extract.train(html_extract.labelled_pages(none.toDF("page_id", "html"), none)) is None


def test_warc(spark, docs, none):
    schema = "page_id long, url string, html string, node string, hash string"
    pages = spark.createDataFrame([(i, None if k % 2 else "u", t, "x", "x") for k, (i, t) in enumerate(ROWS)], schema)
    tree = warc.tree(pages)
    assert warc.audit(tree, warc.tree(pages)).count() == 0
    empty = warc.tree(spark.createDataFrame([], schema))
    leaves = len({i for i, _ in ROWS})
    assert {r.status for r in warc.audit(tree, empty).collect()} == {"missing"} and warc.audit(tree, empty).count() == leaves
    assert warc.audit(empty, tree).filter("status = 'extra' AND bytes = 0").count() == leaves
    assert warc.audit(empty, empty).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, capacity=64).collect()
    of = {}
    for r in rows:
        assert r.n_tokens + r.padding == 64 and r.n_tokens == sum(s.to_token - s.from_token for s in r.spans)
        for s in r.spans:
            of[s.doc_id] = of.get(s.doc_id, 0) + s.to_token - s.from_token
    assert of[2] == 2 * of[1] and 3 not in of and 4 not in of and of[7] == 1 and of[None] == of[1]
    assert packing.pack(none).count() == 0


def test_jaccard(docs, none):
    groups = jaccard_join.groups(docs).collect()
    assert sorted(map(tuple, groups)) == [(1, 1, 3), (2, 1, 3), (9, 1, 3)]
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "None", "4", "5", "6", "7", "8", "-9"])
    assert jaccard_join.groups(none).count() == 0


def test_sanitize(docs, none):
    rows = sanitize.sanitize(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[-9][0].text == "call <EMAIL> now. It's fine!\nIt's fine!" and by[-9][0].n_entities == 1
    assert by[3][0].text is None and by[4][0].text == "" and by[6][0].text == LONG
    assert sanitize.sanitize(none).count() == 0
