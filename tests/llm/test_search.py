"""Ranked search against scores computed one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from samebytes.llm.search import plan_queries, search, terms_of, weight

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=20):
    counted = [(key, Counter(t), len(t)) for key, text in docs if (t := _terms(text))]
    total, length = len(counted), sum(n for _, _, n in counted)
    having = Counter(term for _, c, _ in counted for term in c)
    out = []
    for item, text in items:
        rows = []
        for key, tf, n in counted:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * having[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in _terms(text)
            )
            if score > 0:
                rows.append((-score, key is None, key or 0))
        for rank, (score, null, key) in enumerate(sorted(rows)[:best], 1):
            out.append((item, rank, None if null else key, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _tables(spark, seed, docs=120, items=30):
    draw = random.Random(seed)
    common, rare = ["the", "of", "And", "é", "x1"], [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(draw.choice(common + rare) for _ in range(draw.randint(0, n)))
    texts = [(i if i % 50 else None, say(60)) for i in range(docs)] + [(9000, None), (9001, ""), (9002, "-- ..")]
    texts += [(i, "the of same text w1") for i in range(300, 340)]  # ties
    asked = [(i, say(25)) for i in range(items)] + [(900, "the of w1 w1 w1"), (901, None), (902, "!"), (903, "nowhere"), (None, "w2 the")]
    return texts, asked


@pytest.mark.parametrize(
    "limits", [{}, {"item_bytes": 300, "best": 3}, {"item_bytes": 200, "read_bytes": 700}], ids=["one block", "many blocks", "many readings"]
)
def test_agrees_with_brute_force(spark, limits):
    texts, asked = _tables(spark, 4)
    docs = spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, score string").repartition(6)
    items = spark.createDataFrame([(*a, "r") for a in asked + asked[:3]], "item_id long, text string, rank string")
    result = search(docs, items, **limits)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(result) == brute(texts, asked, limits.get("best", 20))


def test_awkward_rows_and_empty_tables(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "one two word5 MAIL \U0001f600"), (2, "id here")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(search(awkward, items)) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert search(no_docs, items).collect() == [] and search(awkward, items.limit(0)).collect() == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_terms():
    for text in ["A-b\x00Ç é9[z]{y}", "١٢ \x7fÄ\x85ö", "", "  "]:
        assert [t.decode() for t in terms_of(text.encode())] == _terms(text)
    assert weight(10, 10) == math.floor(1000 * math.log(22 / 21))


def _expand(graph, node):
    """Terms of a node with repeats."""
    if node < graph.atoms:
        return Counter(t for t, a in zip(graph.terms, graph.atom_of) if a == node)
    at = node - graph.atoms
    if at < len(graph.multiples):
        atom, times = graph.multiples[at]
        return Counter({t: times * c for t, c in _expand(graph, atom).items()})
    x, y = graph.sums[at - len(graph.multiples)]
    return _expand(graph, x) + _expand(graph, y)


def test_graph_adds_up_to_the_items_and_shares_parts():
    draw = random.Random(1)
    shared = [[f"s{g}_{i}".encode() for i in range(6)] for g in range(5)]
    items = []
    for i in range(60):
        parts = draw.sample(range(5), 2)
        items.append([t for g in parts for t in shared[g]] + [f"own{i}".encode()] * draw.randint(1, 3) + [b"all"])
    items.append([])
    graph = plan_queries(items)
    for terms, nodes in zip(items, graph.items, strict=True):
        assert sum((_expand(graph, n) for n in nodes), Counter()) == Counter(terms)
    assert graph.atoms == 5 + 60 + 1  # one per shared set, own term and common term
    added = len(graph.sums) + sum(len(nodes) for nodes in graph.items)
    assert added < sum(len(set(terms)) for terms in items) / 4
    assert sorted(graph.atom_of) == graph.atom_of
