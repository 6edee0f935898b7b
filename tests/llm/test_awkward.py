"""Awkward rows that the tests of single operators leave out."""

from __future__ import annotations

import pytest

from samebytes.llm import embeddings, near_duplicates, pii, toxicity, urls


def test_toxicity_without_ids_labels_or_rows(spark, awkward, no_docs):
    """Null ids, repeated rows and labels, an empty table and a clashing `score`; without labels the prior is nothing."""
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (9, None), (7, 1)], "doc_id long, toxic int")
    everything = awkward.unionByName(awkward.filter("doc_id IS NULL"))
    out = toxicity.score_toxicity(everything, toxicity.learn_toxicity(everything, labels))
    assert out.count() == everything.count() and out.schema["score"].dataType.simpleString() == "double"
    rows = [r.score for r in out.filter("doc_id = 7").collect()]
    assert len(rows) == 2 and rows[0] == rows[1]
    assert len({r.score for r in out.filter("text IS NULL OR trim(text) = ''").collect()}) == 1
    nothing = toxicity.learn_toxicity(awkward, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(awkward, nothing).collect()} == {round(nothing.score(None), 6)}
    assert nothing.score("any words") < 0.01
    empty = toxicity.learn_toxicity(no_docs, labels)
    assert empty.score("any") == empty.score(None) and toxicity.score_toxicity(no_docs, empty).collect() == []


def test_urls_repeated_labels_and_long_urls(spark):
    long = "http://" + "a" * 5000 + ".example.com/" + "p/" * 20_000 + "?q=" + "x" * 10_000
    rows = [(1, "http://a.com/x", "old"), (1, "http://a.com/x", "old"), (2, long, "old"), (None, "http://a.com/y", None), (3, "http://b.com/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(1, True), (1, True), (1, False), (None, True), (3, None)], "page_id long, bad boolean")
    out = urls.judge_urls(pages, labels)
    assert out.count() == 5 and out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    got = {r.host: r for r in out.collect()}
    assert got["a" * 5000 + ".example.com"].path == "/" + "p/" * 20_000
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    # Two rows of a page count its three labels twice.
    counted = urls.host_reputation(spark.createDataFrame([("a.com", 6, 4), ("b.com", 0, 0)], "host string, n long, bad long"))
    assert {r.host: (r.n, r.bad) for r in counted.collect()} == {"a.com": (6, 4), "b.com": (0, 0)}


def test_strangers_under_a_suffix_of_two_labels(spark):
    def host(name, n, bad):
        return [(f"http://{name}/{i}", i < bad) for i in range(n)]

    rows = host("shop.bad.co.uk", 80, 78) + host("www.good.co.uk", 300, 2) + host("new.bad.co.uk", 1, 1) + host("new.good.co.uk", 1, 1)
    rows += host("a.github.io", 60, 60) + host("b.github.io", 60, 0)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad boolean")
    found = lambda **k: {r.host: r for r in urls.judge_urls(pages, labels, **k).select("host", "verdict", "bad_rate").distinct().collect()}
    out = found()
    assert out["new.good.co.uk"].bad_rate < 0.4 < out["new.bad.co.uk"].bad_rate
    assert (out["a.github.io"].verdict, out["b.github.io"].verdict) == ("block", "allow")
    # Without the list, co.uk is one domain and its hosts share its rate.
    plain = found(suffixes=())
    assert abs(plain["new.good.co.uk"].bad_rate - plain["new.bad.co.uk"].bad_rate) < 1e-9
    names = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("uk",), ("",), ("x.y.com",)], "h string")
    got = [tuple(r) for r in names.select("h", urls.domain_of(names.h).alias("d"), urls.suffix_of(names.h).alias("s")).collect()]
    assert got == [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("uk", "uk", "uk"), ("", "", ""), ("x.y.com", "y.com", "com")]


def test_vectors_with_repeated_rows_and_extra_columns(spark):
    vector, near, far = [1.0, 0.0, 0.0, 1.0], [1.0, 0.01, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, vector, 0, "x", "y"), (1, vector, 0, "x", "y"), (2, near, 0, None, None), (3, far, 0, "x", "y"), (3, near, 0, "x", "y"),
            (None, vector, 0, "x", "y"), (None, None, None, None, None), (4, vector, 1, "x", "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string, node string")
    out = embeddings.near_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    # Ids 1, 2 and one vector of 3 are near each other; repeated rows of id 1 are one vector.
    assert set(got[1]) == {(2, 1, True)} and len(got[1]) == 2
    assert got[2] == [(2, 1, False)] and sorted(n for n, _, _ in got[3]) == [0, 2]
    assert got[4] == [(0, 4, True)] and set(got[None]) == {(0, None, True)}


def test_a_large_group_is_compared_in_blocks(spark, monkeypatch):
    """Several blocks of a cluster, and clusters that meet, count every link once."""
    import numpy as np

    monkeypatch.setattr(embeddings, "BLOCK_VECTORS", 16)
    some = np.random.default_rng(2)
    base = some.normal(size=32)
    points = [base + some.normal(size=32) * 0.12 for _ in range(150)] + [some.normal(size=32) for _ in range(20)]
    unit = np.array([p / np.linalg.norm(p) for p in points])
    close = unit @ unit.T >= embeddings.MIN_COSINE
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(i, p.tolist(), 7) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert got == {i: int(close[i].sum()) for i in range(len(points))} and 0 < close.sum() < 150 * 149


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_with_ids_of_any_kind(spark, kind):
    """Buckets that hold several components compare ids as they are."""
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for n in range(40):
        changed = list(words)
        for k in range(n):
            changed[(7 * k + 3) % 300] = f"x{n % 3}_{k}"
        texts[n] = " ".join(changed)
    name = (lambda n: n) if kind == "long" else (lambda n: f"d{n:03d}")
    docs = spark.createDataFrame([(name(n), t) for n, t in texts.items()], f"doc_id {kind}, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, size=2).collect()}
    sets = {n: set(zip(t.split(), t.split()[1:])) for n, t in texts.items()}
    parent = {n: n for n in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {name(n): name(root(n)) for n in sets}


def test_pii_replaces_clashing_columns(awkward, no_docs):
    clashing = awkward.withColumnRenamed("h", "pii")
    out = pii.add_pii(clashing)
    assert out.columns.count("pii") == 1 and out.count() == awkward.count()
    assert {r.doc_id: [s.kind for s in r.pii] for r in out.collect()}[9][:1] == ["email"]
    assert pii.add_pii(no_docs).collect() == []
