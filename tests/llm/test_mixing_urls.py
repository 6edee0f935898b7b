"""Native operators: mixtures and host reputation."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from samebytes.llm import mixing, urls


def corpus(spark):
    sizes = {"hot": 600, "mid": 120, "small": 40, "tiny": 4}
    rows = [(i, f"{s} " * (3 + i % 7), s) for k, (s, n) in enumerate(sizes.items()) for i in range(k * 1000, k * 1000 + n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_meets_entropy_budget_and_weights(spark):
    docs = corpus(spark)
    out = mixing.mix_sources(docs, block_rows=16, target_entropy=0.8, max_repeats=50).collect()
    tokens = Counter()
    passes = Counter()
    for r in out:
        tokens[r.source] += len(r.text.split())
        passes[r.doc_id, r.mix_epoch] += 1
    budget = docs.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    total = sum(tokens.values())
    # Each source may fall short of its quota by less than one document.
    assert budget - 4 * 10 <= total <= budget
    entropy = -sum(t / total * math.log(t / total) for t in tokens.values()) / math.log(4)
    assert 0.78 < entropy < 0.83
    assert set(passes.values()) == {1}
    for name in ("hot", "mid", "small", "tiny"):
        epochs = [r.mix_epoch for r in out if r.source == name]
        full = max(epochs) - 1
        per_doc = Counter(r.doc_id for r in out if r.source == name)
        assert set(per_doc.values()) <= {full, full + 1} - {0}


def test_repetition_limit(spark):
    out = mixing.mix_sources(corpus(spark), block_rows=16, target_entropy=1.0, max_repeats=3.0)
    assert out.agg(F.max("mix_epoch")).first()[0] <= 3
    assert mixing.mix_sources(corpus(spark), block_rows=16, target_entropy=1.0, max_repeats=100.0).agg(F.max("mix_epoch")).first()[0] > 3


def test_whole_blocks_but_the_last(spark):
    docs = corpus(spark)
    out = mixing.mix_sources(docs, block_rows=16, budget=1500.0, target_entropy=0.0)
    hot = docs.filter("source = 'hot'").count()
    taken = out.filter("source = 'hot'")
    assert 0 < taken.count() < hot
    key = mixing.place("mix", F.col("doc_id")) % math.ceil(hot / 16)
    sizes = dict(docs.filter("source = 'hot'").groupBy(key.alias("b")).count().collect())
    got = dict(taken.groupBy("mix_block").count().collect())
    assert sum(got[b] < sizes[b] for b in got) <= 1


def test_mixing_of_awkward_rows(spark, awkward, no_docs):
    clashing = awkward.withColumn("mix_epoch", F.lit("old"))
    out = mixing.mix_sources(clashing, target_entropy=0.0)
    assert out.filter("doc_id = 7").count() == 2
    assert out.count() == awkward.filter("source IS NOT NULL OR doc_id IS NULL OR doc_id IN (3, 8)").count()
    assert mixing.mix_sources(no_docs).count() == 0


def test_hosts_paths_and_rules(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de", "example.net", "/de", "net/", "block"),
        ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("x://m.example.com/de/?a=/b", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.org?y=/fr/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, True), (3, None)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels, rules).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge_urls(pages.limit(0), labels, rules).count() == 0


def test_reputation_shrinks_from_host_to_suffix(spark):
    def host(name, n, bad):
        return [(f"http://{name}/{i}", i < bad) for i in range(n)]

    rows = host("bad.a.com", 60, 55) + host("good.b.com", 400, 10) + host("new.a.com", 1, 1) + host("new.b.com", 1, 1)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad boolean")
    out = {r.host: r for r in urls.judge_urls(pages, labels).select("host", "verdict", "bad_rate", "bad_bound").distinct().collect()}
    assert out["bad.a.com"].verdict == "block" and out["good.b.com"].verdict == "allow"
    assert out["good.b.com"].bad_rate < out["new.b.com"].bad_rate < out["new.a.com"].bad_rate
    assert all(r.bad_bound < r.bad_rate for r in out.values())
