"""Exact duplicates against a dictionary of contents."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest

from samebytes.llm.exact import ContentTable, exact_duplicates


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups: dict[str, list] = {}
    for key, text in rows:
        groups.setdefault(_lower(text), []).append(key)
    out = []
    for key, text in rows:
        group = groups[_lower(text)]
        keep = max((k for k in group if k is not None), default=None)
        out.append((key, keep, len(group), key == keep, sha256(_lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _rows(seed=5, n=600):
    draw = random.Random(seed)
    texts = ["hot", "HOT", "hoTÉ", "hoté", "", None, "a" * 5000, "KK"] + [f"text {i} {'x' * draw.randint(0, 300)}" for i in range(150)]
    return [(i if draw.random() < 0.95 else None, "Hot" if i % 3 == 0 else draw.choice(texts)) for i in range(n)] + [(3, "Hot"), (7, "z")]


@pytest.mark.parametrize(
    "limits",
    [{}, {"bucket_bytes": 1500}, {"digest_bytes": 1}, {"bucket_bytes": 1500, "digest_bytes": 1}, {"bucket_bytes": 1}],
    ids=str,
)
def test_agrees_with_a_dictionary(spark, limits):
    """Small tables spill to further levels, and short digests make different contents meet."""
    rows = _rows(n=120 if limits.get("bucket_bytes") == 1 else 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(exact_duplicates(docs, **limits)) == brute(rows)


def test_awkward_rows(awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    result = exact_duplicates(awkward.withColumnRenamed("n_chars", "keep_id"))
    assert found(result) == brute(rows)
    assert result.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact_duplicates(no_docs).collect() == []


def test_text_ids(spark):
    rows = [("b", "x"), ("a", "X"), (None, "x"), ("é", "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(exact_duplicates(docs)) == brute(rows)


def test_a_full_table_settles_what_it_holds():
    table = ContentTable(500)
    taken = [table.add(sha256(c).digest(), c, i, 1, False)[0] for i, c in enumerate([b"a", b"b", b"c", b"a", b"c"])]
    assert taken == [True, True, False, True, False]
    assert [(e[1], e[2], e[3]) for e in table.entries()] == [(b"a", 3, 2), (b"b", 1, 1)]


def test_a_table_grows_and_tells_clashing_digests_apart():
    table = ContentTable(1 << 30)
    for i in range(3000):
        assert table.add(bytes([i % 7]), str(i % 1500).encode(), i, 1, False)[0]
    entries = list(table.entries())
    assert len(entries) == 3000  # each content comes with two digests
    assert all(e[4] for e in entries)


def test_hot_contents_arrive_combined(spark):
    """Whatever the number of rows, a map task sends one record of a content."""
    from samebytes.llm.exact import _records

    rows = spark.range(9000, numPartitions=3).selectExpr("id", "if(id % 3 > 0, 'hot', 'other') AS text")
    assert _records(rows, "bigint", 1 << 20, 32).count() == 6
