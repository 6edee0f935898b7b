"""Periodic runs of words by enumerating maximal pairs.

A maximal pair of a word sequence are two places with a common stretch of words that can be extended
neither to the left nor to the right. Pairs are read from the tree of LCP intervals, bottom-up: a
place of one child of an interval and a place of another child have exactly the interval's length in
common, and the pair is maximal if the words on their left differ, so an interval keeps its places
in one list per left word. A pair at distance d whose common stretch has at least d words spans a
stretch of period d that cannot be extended: it is a run, and no further comparison is needed.
Multiples of a period give pairs with the same ends, of which the smallest distance counts.

A run of 12 words or more gives a pair with 6 words in common, so only intervals at least that deep
are built: the places are sorted by 3 words, 6 words, 12 words and so on, as long as several are equal.
Intervals without two left words, or whose nearest places are further apart than any stretch they have
in common, hold no run and are left out. Documents are worked on in slices of some 100,000 words.

Searching the larger of two children for places near those of the smaller one takes a logarithmic time
for each left word, or looks at the places in reach if those are fewer; pairs that satisfy the
distance are at most about three per word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import ship

#: Fewest words of a run.
LEAST_WORDS = 12
#: Words of documents that are sorted together; a longer document is a slice of its own.
SLICE_WORDS = 1 << 18

#: Left words of which an interval keeps one list each before it also keeps one of all places.
_FEW_CLASSES = 16


def _ranks(keys: np.ndarray) -> np.ndarray:
    """For every key the number of smaller ones, which is equal for equal keys only."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.empty(len(keys), bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return ranks


class _Slice:
    """Word numbers of several documents in a row; `starts` has the first place of each, and the end."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, least: int):
        self.codes, self.n, self.least = codes, len(codes), least
        sizes = np.diff(starts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.repeat(starts[1:], sizes)
        self.start = np.repeat(starts[:-1], sizes)

    def _ahead(self, values: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """One more than the value `step` places on, or 0 past the end of the document."""
        there = places + step
        return np.where(there < self.end[places], values[np.minimum(there, self.n - 1)].astype(np.int64) + 1, 0)

    def _sort(self) -> None:
        """Ranks of all places by 1, 3, 6, 12, ... words, within their documents."""
        every, words = np.arange(self.n), int(self.codes.max()) + 2
        keys, top = self.doc * np.int64(words) + self.codes, (int(self.doc[-1]) + 1) * words
        self.levels: list[tuple[int, np.ndarray]] = [(1, keys)]
        for step in (1, 2):
            if top * words >= 1 << 62:
                keys, top = _ranks(keys).astype(np.int64), self.n
            keys, top = keys * words + self._ahead(self.codes, every, step), top * words
        width, ranks = 3, _ranks(keys)
        self.levels.append((width, ranks))
        ranks = _ranks(ranks * np.int64(self.n + 1) + self._ahead(ranks, every, width))
        width = 6
        self.levels.append((width, ranks))
        sizes = np.bincount(ranks, minlength=self.n)
        self.sixes, open_ = ranks, every[sizes[ranks] > 1]
        self.repeated = open_
        while len(open_):
            keys = ranks[open_] * np.int64(self.n + 1) + self._ahead(ranks, open_, width)
            order = np.argsort(keys)
            open_, keys = open_[order], keys[order]
            group = ranks[open_]
            fresh, split = np.empty(len(keys), bool), np.empty(len(keys), bool)
            fresh[0] = split[0] = True
            np.not_equal(group[1:], group[:-1], out=fresh[1:])
            np.not_equal(keys[1:], keys[:-1], out=split[1:])
            index = np.arange(len(keys))
            offset = np.maximum.accumulate(np.where(split, index, 0)) - np.maximum.accumulate(np.where(fresh, index, 0))
            ranks = ranks.copy()
            ranks[open_] = group + offset
            width *= 2
            self.levels.append((width, ranks))
            alone = split & np.append(split[1:], True)
            open_ = open_[~alone]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at `a` and `b` of one document have in common."""
        length = np.zeros(len(a), np.int64)
        for width, ranks in [*self.levels[:0:-1], self.levels[0], self.levels[0]]:
            x, y = a + length, b + length
            inside = (x < self.end[a]) & (y < self.end[b])
            last = self.n - 1
            length += width * (inside & (ranks[np.minimum(x, last)] == ranks[np.minimum(y, last)]))
        return length

    def groups(self) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Sorted suffixes of each top interval that can hold a run, their LCPs, and their left words."""
        if self.n < self.least:
            return
        self._sort()
        if not len(self.repeated):
            return
        sorted_ = self.repeated[np.argsort(self.levels[-1][1][self.repeated])]
        group = self.sixes[sorted_]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        common = np.append(0, self._common(sorted_[:-1], sorted_[1:]))
        common[first] = 0
        left = np.where(sorted_ > self.start[sorted_], self.codes[np.maximum(sorted_ - 1, 0)], -1)
        by_place = np.sort(group * np.int64(self.n) + sorted_)
        gap = np.append(self.n, np.diff(by_place))
        gap[first] = self.n
        wanted = (
            (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first))
            & (np.minimum.reduceat(gap, first) <= np.maximum.reduceat(common, first))
        )
        ends = np.append(first[1:], len(sorted_))
        for at, to in zip(first[wanted].tolist(), ends[wanted].tolist(), strict=True):
            yield sorted_[at:to].tolist(), common[at:to].tolist(), left[at:to].tolist()


class _Places:
    """Places of an interval, in one sorted list per left word."""

    __slots__ = ("classes", "every", "size")

    def __init__(self, place: int, left: int):
        self.classes, self.every, self.size = {left: [place]}, None, 1

    def near(self, place: int, left: int, reach: int) -> Iterator[int]:
        """Places at most `reach` away whose left word is another."""
        low, high = place - reach, place + reach
        if self.every is not None:
            a, b = bisect_left(self.every, (low,)), bisect_left(self.every, (high + 1,))
            own = self.classes.get(left, ())
            if b - a == bisect_right(own, high) - bisect_left(own, low):
                return
            if b - a < len(self.classes):
                for at in range(a, b):
                    if self.every[at][1] != left:
                        yield self.every[at][0]
                return
        for other, places in self.classes.items():
            if other != left:
                yield from places[bisect_left(places, low) : bisect_right(places, high)]

    def add(self, other: _Places) -> None:
        for left, places in other.classes.items():
            own = self.classes.setdefault(left, [])
            for place in places:
                insort(own, place)
                if self.every is not None:
                    insort(self.every, (place, left))
        self.size += other.size
        if self.every is None and len(self.classes) > _FEW_CLASSES:
            self.every = sorted((p, left) for left, places in self.classes.items() for p in places)


def _pairs(suffixes: list[int], common: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs of one top interval as two places and a length, at most that length apart."""
    stack: list[tuple[_Places, int]] = []
    for at, place in enumerate(suffixes):
        current = _Places(place, left[at])
        ahead = common[at + 1] if at + 1 < len(suffixes) else 0
        while stack and stack[-1][1] >= ahead:
            before, length = stack.pop()
            large, small = (before, current) if before.size >= current.size else (current, before)
            for word, places in small.classes.items():
                for one in places:
                    for other in large.near(one, word, length):
                        yield min(one, other), max(one, other), length
            large.add(small)
            current = large
        stack.append((current, ahead))


def runs_of(documents: list[list], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """Runs of every document (a list of words) as start, length and period, by start and period.

    A run has at least `least` words, 12 or more, and at least two periods.
    """
    numbers: dict = {}
    for words in documents:
        numbers.update(dict.fromkeys(words))
    numbers = {word: i for i, word in enumerate(numbers)}
    long = [i for i, words in enumerate(documents) if len(words) >= least]
    found: list[dict[tuple[int, int], int]] = [{} for _ in documents]
    if long:
        starts = np.cumsum([0, *[len(documents[i]) for i in long]])
        codes = np.fromiter((numbers[w] for i in long for w in documents[i]), np.int64, int(starts[-1]))
        part = _Slice(codes, starts, least)
        for suffixes, common, left in part.groups():
            doc = int(part.doc[suffixes[0]])
            origin, ends = int(starts[doc]), found[long[doc]]
            for a, b, length in _pairs(suffixes, common, left):
                period = b - a
                if period + length >= least:
                    key = (a - origin, b + length - origin)
                    ends[key] = min(period, ends.get(key, period))
    return [sorted((a, b - a, period) for (a, b), period in ends.items()) for ends in found]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def find_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    least: int = LEAST_WORDS, slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """One row per row of `docs`: the id, `n_words`, `runs` and `collapsed`.

    Words are what blanks and the control characters 9 to 13 separate. A run is a stretch of words
    with smallest period q and at least max(`least`, 2 * q) words that no neighbouring word extends
    with period q; `runs` has start (word number from 0), length and period of each, by start and
    period. `collapsed` is the text with one period of each run left, its words joined by one blank.
    Null and empty texts and texts without words have no runs and an empty `collapsed`; a null id
    stays null, repeated rows are worked on each. Texts of any length are searched whole, and memory
    grows with the longest one. `least` has to be 12 or more. Other columns are left out, so their
    names do not matter. An empty table gives an empty one.
    """
    if least < LEAST_WORDS:
        raise ValueError(f"runs of fewer than {LEAST_WORDS} words are not searched")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        documents: list[list[bytes]] = []
        held, schema = 0, None

        def done() -> pa.RecordBatch:
            runs = runs_of(documents, least)
            texts = [b" ".join(collapse(w, r)) for w, r in zip(documents, runs, strict=True)]
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs]
            columns = [keys, [len(w) for w in documents], named]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

        for batch in batches:
            kind = batch.schema.field("id").type
            schema = pa.schema([("id", kind), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for key, value in zip(part.column("id").to_pylist(), texts, strict=True):
                    words = value.split() if value else []  # of bytes, at ASCII white space only
                    if documents and held + len(words) > slice_words:
                        yield done()
                        keys, documents, held = [], [], 0
                    keys.append(key)
                    documents.append(words)
                    held += len(words) + 16
        if documents:
            yield done()

    found = rows.mapInArrow(
        work, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    )
    return found.withColumnRenamed("id", id)
