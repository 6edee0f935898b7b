"""Passages by the CGK embedding against plain dynamic programming."""

from __future__ import annotations

import random

from samebytes.llm import decontamination as dc


def distance(item, stretch):
    """Smallest edit distance of an item to any part of a stretch."""
    before = [0] * (len(stretch) + 1)
    for i, word in enumerate(item, 1):
        row = [i]
        for j, other in enumerate(stretch, 1):
            row.append(min(before[j - 1] + (word != other), before[j] + 1, row[j - 1] + 1))
        before = row
    return min(before)


def edited(words, edits, pool, some):
    words = list(words)
    for _ in range(edits):
        at, kind = some.randrange(len(words)), some.random()
        if kind < 0.4:
            words[at] = some.choice(pool)
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, some.choice(pool))
    return words


def test_bit_parallel_distance():
    some = random.Random(2)
    for _ in range(2000):
        item = [some.randint(1, 4) for _ in range(some.randint(1, 12))]
        stretch = [some.randint(0, 4) for _ in range(some.randint(0, 14))]
        assert dc.passage_distance(item, stretch)[0] == distance(item, stretch)


def test_search_agrees_with_brute_force(spark):
    some = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    items = [(n, " ".join(some.choice(pool) for _ in range(some.choice((5, 8, 15, 30, 60))))) for n in range(60)]
    items += [(900, "too short"), (901, None), (902, ""), (0, items[0][1])]
    docs = []
    for n in range(240):
        words = [some.choice(pool) for _ in range(some.randint(0, 80))]
        own = dc.words_of(items[n % 60][1])
        edits = some.randint(0, dc.edits_allowed(len(own)) + 1)
        docs.append((n, " ".join(words + edited(own, edits, pool, some) + words[::-1])))
    docs += [(900, None), (901, "")]
    found = dc.find_passages(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        # Several blocks of items.
        block_bytes=2000,
    ).collect()
    got = {(r.doc_id, p.item): p.distance for r in found for p in r.passages}
    expected = {}
    for n, text in docs:
        for name, item in items:
            words = dc.words_of(item)
            if len(words) >= dc.MIN_WORDS:
                d = distance(words, dc.words_of(text))
                if d <= dc.edits_allowed(len(words)):
                    expected[n, name] = d
    assert got.keys() <= expected.keys()
    assert len(got.keys() & expected.keys()) >= 0.97 * len(expected)
    assert all(got[k] >= expected[k] for k in got)
    exact = [k for k, d in expected.items() if d == 0]
    assert exact and all(got.get(k) == 0 for k in exact)


def test_awkward_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "some words that are not there at all"), (None, None)], "item_id long, text string")
    assert {len(r.passages) for r in dc.find_passages(awkward, items).collect()} == {0}
    assert dc.find_passages(awkward, items.limit(0)).filter("size(passages) = 0").count() == awkward.count()
    assert dc.find_passages(no_docs, items).count() == 0


def test_recall_at_the_edit_limit_by_length():
    """Items of every length are found after as many edits as are allowed, of one kind or mixed."""
    some = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    for size in (15, 25, 59, 100, 200, 400):
        items = [(n, " ".join(some.choice(pool) for _ in range(size))) for n in range(25)]
        wanted, docs = [], []
        for n, text in items:
            for kind in ("replace", "delete", "insert", "mixed"):
                fresh = (["foreign"], pool, [f"x{i}" for i in range(9999)])[n % 3]
                words = dc.edit_codes(text.split(), dc.edits_allowed(size), kind, fresh, some)
                around = [some.choice(pool) for _ in range(60)]
                wanted.append(n)
                docs.append(" ".join(around + words + around[::-1]))
        found = dc.ItemIndex(items, dc.EDIT_SHARE, dc.MIN_WORDS).search(docs)
        recall = sum(any(p[0] == n for p in passages) for n, passages in zip(wanted, found, strict=True)) / len(docs)
        assert recall >= 0.97, (size, recall)


def test_class_that_walks_do_not_find_is_verified_whole(monkeypatch):
    monkeypatch.setattr(dc, "MOST_WALKS", 1)
    some = random.Random(6)
    pool = [f"w{i}" for i in range(500)]
    items = [(n, " ".join(some.choice(pool) for _ in range(50))) for n in range(20)]
    index = dc.ItemIndex(items, dc.EDIT_SHARE, dc.MIN_WORDS)
    docs = [" ".join(["a"] * 9 + edited(text.split(), 10, pool, some) + ["b"] * 9) for _, text in items]
    assert [group.walks for group in index.classes] == [0]
    assert [[p[0] for p in found] for found in index.search(docs)] == [[n] for n, _ in items]


def test_short_items_are_found_without_edits():
    items = [(1, "Blue moon"), (2, "yes"), (3, "one two three four"), (4, ""), (5, "blue moon"), (6, "a b c d e f")]
    index = dc.ItemIndex(items, dc.EDIT_SHARE, dc.MIN_WORDS)
    found = index.search(["blue, MOON.", "One two three for four", "so: one two three four blue sky moon", None, "a b c d e f yes"])
    assert found == [[(1, 0, 1), (5, 0, 1)], [], [(3, 0, 4)], [], [(2, 0, 6), (6, 0, 5)]]
    assert dc.ItemIndex(items[:2], dc.EDIT_SHARE, dc.MIN_WORDS).search(["yes"]) == [[(2, 0, 0)]]


def test_blocks_of_items_one_at_a_time(spark, awkward, monkeypatch):
    """Many blocks find what one block finds; no more than one is held, and ids may be text."""
    some = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    items = [(f"item-{n}" if n else None, " ".join(some.choice(pool) for _ in range(some.choice([3, 12, 45])))) for n in range(24)]
    texts = [" ".join([some.choice(pool) for _ in range(30)] + [t for _, t in some.sample(items, 2)] + [some.choice(pool) for _ in range(9)]) for _ in range(40)]
    docs = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate([*texts, None, "", "same"])], "doc_id long, text string, _row string, passages string").repartition(3)
    table = spark.createDataFrame(items, "item_id string, text string")
    sizes = []
    index = dc.ItemIndex.__init__
    monkeypatch.setattr(dc.ItemIndex, "__init__", lambda self, block, *a: (sizes.append(sum(len(t) for _, t in block)), index(self, block, *a))[1])
    whole = dc.find_passages(docs, table)
    parts = dc.find_passages(docs, table, block_bytes=200)
    assert len(sizes) > 6 and max(sizes[1:]) < 0.75 * sizes[0]
    assert parts.columns == whole.columns == ["doc_id", "text", "_row", "passages"]
    assert parts.schema["passages"].dataType.elementType["item"].dataType.simpleString() == "string"
    found = [{(r.doc_id, p.item, p.distance, p.last_word) for r in df.collect() for p in r.passages} for df in (whole, parts)]
    assert found[0] == found[1] and len(found[0]) >= 80 and parts.count() == 43
    assert {r._row for r in parts.collect()} == {"x"}
