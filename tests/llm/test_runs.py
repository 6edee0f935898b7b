"""Runs against comparison of all periods at all places."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samebytes.llm.queries import QUERIES
from samebytes.llm.runs import collapse, find_runs, runs_of


def brute(words, least=12):
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        start = 0
        while start + period < n:
            end = start
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if length >= max(least, 2 * period):
                found.setdefault((start, length), period)  # the smallest period comes first
            start = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70) | st.lists(st.sampled_from("abc"), max_size=70), max_size=4))
def test_random_words(documents):
    assert runs_of(documents) == [brute(words) for words in documents]


def _periodic(draw, n, letters):
    words = [draw.choice(letters) for _ in range(n)]
    for _ in range(draw.randint(0, 4)):
        at, period, times = draw.randrange(n), draw.randint(1, 12), draw.uniform(1.5, 9)
        for i in range(at + period, min(n, at + int(period * times))):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("letters", ["ab", "abcd", [f"w{i}" for i in range(200)]], ids=["two", "four", "many"])
def test_planted_periods(letters):
    draw = random.Random(8)
    documents = [_periodic(draw, draw.randint(1, 220), letters) for _ in range(150)]
    assert runs_of(documents) == [brute(words) for words in documents]


def test_one_word_repeated_is_not_quadratic():
    words = [b"a"] * 20_000
    assert runs_of([words, [b"b"], words[:12]]) == [[(0, 20_000, 1)], [], [(0, 12, 1)]]
    assert collapse(words, [(0, 20_000, 1)]) == [b"a"]


def test_many_left_words_and_near_repeats():
    """A frequent passage behind many different words, with some near copies among them."""
    phrase = list("abcdefg")
    words = [w for i in range(400) for w in [f"x{i}", *phrase, *(phrase if i % 40 == 0 else [])]]
    assert runs_of([words]) == [brute(words)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs_of([list(fibonacci[-1])]) == [brute(fibonacci[-1])]


def test_very_many_different_words():
    """Three word numbers no longer fit one key."""
    words = [f"w{i}" for i in range(1_700_000)] + ["p", "q"] * 10
    assert runs_of([words, ["p"] * 12]) == [[(1_700_000, 20, 2)], [(0, 12, 1)]]


def _split(text):
    return (text or "").encode().split()


def test_rows(spark, awkward, no_docs):
    result = {}
    for r in find_runs(awkward.withColumnRenamed("h", "runs"), slice_words=10).collect():
        result.setdefault(r.doc_id, []).append(r)
    for row in awkward.collect():
        got, words = result[row.doc_id][0], _split(row.text)
        runs = [tuple(r) for r in got.runs]
        assert got.n_words == len(words) and got.collapsed.encode() == b" ".join(collapse(words, runs))
        if len(words) < 1000:
            assert runs == brute(words)
    assert len(result[7]) == 2 and find_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        find_runs(no_docs, least=11)


def test_other_separators_are_part_of_words(spark):
    text = " ".join(["a b\x1cc d", "x\x85y"] * 6)
    docs = spark.createDataFrame([(1, text), (2, text.replace(" ", "\x0b\x0c\r\n\t "))], "doc_id long, text string")
    for row in find_runs(docs).collect():
        assert [tuple(r) for r in row.runs] == [(0, 12, 2)] and row.collapsed == "a b\x1cc d x\x85y"


def _expected(doc_id, text):
    words = _split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        sha256(b" ".join(collapse(words, runs))).hexdigest(),
    )


def test_query_agrees_with_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, " ".join(_periodic(draw, draw.randint(1, 90), "abc"))) for i in range(300)]
    rows += [(1000 + i, text) for i, text in enumerate([None, "", " \n", "a " * 12, "a " * 11, "x"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = next(q for name, q in QUERIES.items() if name.startswith("op12_"))
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == sorted(_expected(*row) for row in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
