"""SetSketch near-duplicates and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from samebytes.llm import near_duplicates as nd
from samebytes.llm.components import connected_components
from tests_llm_helpers import brute_components


def shingles(text, size):
    words = nd.words_of(text)
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = [
        (a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
        if x and y and None not in (a, b) and a != b and 100 * len(x & y) >= percent * len(x | y)
    ]
    return brute_components(links, {i for i, _ in rows if i is not None})


def copies(seed):
    """A large group of copies at all distances, small groups, and unrelated texts."""
    some = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for group, size in enumerate((160, 30, 8, 2, 1, 1, 1)):
        base = [some.choice(words) for _ in range(60 + 10 * group)]
        for _ in range(size):
            text = [some.choice(words) if some.random() < some.choice((0, 0.02, 0.06, 0.1)) else w for w in base]
            rows.append((number * 7919 % 1009, " ".join(text)))
            number += 1
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, monkeypatch, size):
    # Small blocks, so that several meet.
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 500)
    rows = copies(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, size=size).collect()}
    assert got == brute(rows, size)


def test_awkward_rows(spark, awkward, no_docs):
    got = nd.near_duplicates(awkward, size=2).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[7].component_id, by_id[7].kept, by_id[1].kept) == (1, False, True)
    assert [by_id[i].n_shingles for i in (2, 3, 4, 8)] == [0] * 4 and by_id[None].kept
    assert nd.near_duplicates(no_docs).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (9, "v w x y z"), (3, "a b c d e")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {3}


def test_sketches_merge_and_estimate():
    some = np.random.default_rng(3)
    pool = some.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:2400]
    merged = nd.registers_of(np.union1d(a, b))
    assert (np.maximum(nd.registers_of(a), nd.registers_of(b)) == merged).all()
    estimate = nd.joint_similarity(
        nd.registers_of(a)[None], nd.registers_of(b)[None], np.array([2000.0]), np.array([2000.0])
    )[0]
    assert abs(estimate - 1600 / 2400) < 0.12


def test_random_graphs(spark):
    some = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(some.randint(0, 90), some.randint(0, 90)) for _ in range(60)]
    links += [(200, 200 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == brute_components(real, {v for e in real for v in e})
    assert connected_components(df.limit(0)).count() == 0
