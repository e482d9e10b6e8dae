"""Links of the Jaccard join against brute force, and what a growing group of near copies costs."""

import itertools
import random

import numpy as np
import pytest

from lakelog.llm import jaccard_join

from test_brute_force import b_groups, corpus, edited, frame, grams, joined, text


def b_links(docs, n, threshold):
    sets = {i: grams(t, n) for i, t in docs}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            for i in (a, b):
                out[i] = out.get(i, 0) + 1
    return out


def near_copies(r, m):
    base = " ".join(text(r) for _ in range(4))
    return [edited(r, base, r.choice([0, 0.02, 0.05, 0.1, 0.15])) for _ in range(m)]


@pytest.mark.parametrize(("n", "threshold", "how"), [(5, 0.5, {}), (2, 0.5, {"tile": 4}), (3, 0.7, {"most": 900}), (1, 0.4, {"tile": 3, "hot": 3, "part": 2}), (2, 0.5, {"part": 2}), (2, 0.9, {})])
def test_links(spark, n, threshold, how):
    """Each link counts, also between members of a group that others connect, and to copies."""
    r = random.Random(n)
    docs = corpus(n + 20) + [(500 + k, t) for k, t in enumerate(near_copies(r, 40))]
    docs += [(1000 + k, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))) for k in range(40)]
    docs += [(2000, ""), (2001, None)]
    out = jaccard_join.links(frame(spark, docs), n=n, threshold=threshold, **how)
    rows = out.collect()
    assert {x.doc_id: x.n_links for x in rows} == b_links(docs, n, threshold)
    assert len(rows) == len({x.doc_id for x in rows}) and joined(out) == b_groups(docs, n, threshold)


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Pairs that are shipped one by one don't grow with the square of a group of near copies."""
    shipped = []
    persist = jaccard_join.persist

    def counted(df, name, *a):
        out = persist(df, name, *a)
        if name == "pairs":
            shipped.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "persist", counted)
    r = random.Random(1)
    docs = list(enumerate(near_copies(r, 300)))
    assert joined(jaccard_join.groups(frame(spark, docs))) == b_groups(docs)
    assert sum(shipped) < 2 * len(docs)


def test_stage_with_a_large_group(spark, monkeypatch):
    """The pipeline's stage keeps one of a group without shipping its pairs one by one."""
    import corpus_pipeline

    shipped = []
    persist = jaccard_join.persist

    def counted(df, name, *a):
        out = persist(df, name, *a)
        if name == "pairs":
            shipped.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "persist", counted)
    docs = list(enumerate(near_copies(random.Random(2), 200)))
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, table, "").collect()}
    assert kept == {i for i, _ in docs} - {i for g, m in b_groups(docs).items() for i in m if i != g}
    assert sum(shipped) < 2 * len(docs)


@pytest.mark.parametrize("dense", [0, 100, 10**9])
def test_overlaps_and_forest(dense, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 3)
    monkeypatch.setattr(jaccard_join, "PAIRS", 7)
    r = np.random.default_rng(3)
    for left, right in ((1, 1), (5, 8), (9, 2)):
        sets = [set(r.choice(30, r.integers(0, 20), replace=False).tolist()) for _ in range(left + right)]
        found = jaccard_join.overlaps(np.array([g for s in sets for g in s], np.uint64), np.repeat(np.arange(left + right), [len(s) for s in sets]), left, right)
        assert found.tolist() == [[len(a & b) for b in sets[left:]] for a in sets[:left]]
        ok = found > 4
        rows, columns = jaccard_join.forest(ok)
        assert ok[rows, columns].all() and len(rows) < left + right
        root = list(range(left + right))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(rows.tolist(), columns.tolist()):
            root[find(a)] = find(left + b)
        assert all(find(a) == find(left + b) for a, b in zip(*np.nonzero(ok)))


@pytest.mark.parametrize("shape", ["chain", "forest", "none"])
def test_components_in_few_rounds(spark, monkeypatch, shape):
    """Rounds don't grow with the length of a chain; with and without the driver's part they are the same."""
    written = []
    persist = jaccard_join.persist
    monkeypatch.setattr(jaccard_join, "persist", lambda df, name, *a: (written.append(name), persist(df, name, *a))[1])
    r = random.Random(4)
    ids = [r.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    edges = {"chain": list(zip(ids, ids[1:])), "forest": [(r.choice(ids), r.choice(ids)) for _ in range(250)], "none": []}[shape]
    edges = [e for e in edges if e[0] != e[1]]
    want = {i: i for e in edges for i in e}
    for _ in range(len(ids)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
        if all(want[a] == want[b] for a, b in edges):
            break
    table = spark.createDataFrame(edges, "a long, b long")
    for how in ({"local": 0}, {}):
        assert {x.fp: x.label for x in jaccard_join.components(table, **how).collect()} == want
    assert written.count("labels") < 20  # of a chain of 400


def test_pairs_that_meet_by_chance(spark, monkeypatch):
    """Sets that share a few grams with many others, but with none enough, have no rows of pairs."""
    rows = []
    # the sketch doesn't tell frequent grams from rare ones
    monkeypatch.setattr(jaccard_join, "CELLS", 16)
    map_arrow = type(frame(spark, [(1, "a")])).mapInArrow

    def counted(self, run, schema, *a, **how):
        out = map_arrow(self, run, schema, *a, **how)
        if schema == "a long, b long, shared long, need int":
            rows.append(out.count())
        return out

    monkeypatch.setattr(type(frame(spark, [(1, "a")])), "mapInArrow", counted)
    r = random.Random(5)
    phrases = [" ".join(f"p{k}x{j}" for j in range(6)) for k in range(3)]
    docs = []
    for i in range(80):
        words = [f"w{r.randrange(10**9)}" for _ in range(60)]
        docs.append((i, " ".join(words[:30] + [r.choice(phrases)] + words[30:])))
    docs += [(100 + i, edited(r, docs[i][1], 0.03)) for i in range(20)]
    assert joined(jaccard_join.groups(frame(spark, docs))) == b_groups(docs)
    assert rows and sum(rows) < len(docs)


def test_passages_do_not_chain_clusters(spark, monkeypatch):
    """Unlike documents that have passages in common, each with others, aren't shipped to be compared all with all."""
    shipped = []
    persist = jaccard_join.persist

    def counted(df, name, *a):
        out = persist(df, name, *a)
        if name == "clusters":
            shipped.append(sum(x.m * x.blocks for x in out.collect()))
        return out

    monkeypatch.setattr(jaccard_join, "persist", counted)
    # the sketch doesn't tell frequent grams from rare ones
    monkeypatch.setattr(jaccard_join, "CELLS", 16)
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passages = [words(14) for _ in range(20)]
    docs = []
    for i in range(150):
        rest = words(r.choice([40, 55, 75, 100, 130]))
        a, b = r.sample(passages, 2)
        docs.append((i, " ".join(rest[:20] + a + rest[20:] + b)))
    docs += [(1000 + i, edited(r, docs[i][1], 0.03)) for i in range(20)]
    out = jaccard_join.links(frame(spark, docs), tile=8)
    assert {x.doc_id: x.n_links for x in out.collect()} == b_links(docs, 5, 0.5)
    assert joined(out) == b_groups(docs)
    assert sum(shipped) < 2 * len(docs)
