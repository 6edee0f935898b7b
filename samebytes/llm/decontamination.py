"""Benchmark passages in documents, found within an edit distance.

Documents and items are sequences of lower-cased words. A passage is a stretch of a document
that becomes an item by at most `EDIT_SHARE` of the item's words being inserted, deleted or
replaced. Candidates come from the CGK embedding: a pointer walks over a sequence and, at every
step, emits the word under it and moves on or stays by a random bit of step and word. Sequences
at a small edit distance have walks at a small Hamming distance, so equal words at sampled steps
are a locality-sensitive hash of edit distance.

Walks of long sequences drift apart, so items of `2 * SEGMENT_WORDS` words or more are cut into
segments: of a passage within the item's edit limit, at least one segment is within its own (the
shares of the edits cannot all be above average). Segments are grouped into length classes. How
many walks a class takes is found when the index is built: segments are edited at random up to
their limit, and walks are added until `RECALL` of them are found, for every kind of edit.

Every window of a class's size is walked, from each word of a document. Windows that share too few three-word sequences with all items together to be
within the edit limit of any of them (q-gram lemma, so none is lost) are not walked. Candidates
are verified by a bit-parallel computation of the exact edit distance.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import Workspace, materialize, ship
from samebytes.operators.scale import lookup_join

#: Edits allowed per word of an item, rounded down; items of fewer words are found without edits only.
EDIT_SHARE, MIN_WORDS = 0.2, 5
#: Walks at least, sampled hashes per walk and steps per hash.
WALKS, TABLES, SAMPLES = 8, 6, 4
#: Share of segments with as many edits as allowed that walks have to find, and trials per kind of edit.
RECALL, TRIALS = 0.99, 256
#: A class that needs more walks has every window that survives verified against all its segments.
MOST_WALKS = 256
#: Shortest segment of a long item; the longest has one word less than two of them.
SEGMENT_WORDS = 20
#: Segments of a length class differ by at most this factor.
CLASS_RATIO = 1.1
#: Text of items per block. One block is on the driver and in tasks at a time, and is searched in a scan of its own.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_GRAM = 3
_EDIT_KINDS = ("replace", "delete", "insert", "mixed")
_WORD_FACTOR, _FOREIGN = np.uint64(0xA0761D6478BD642F), 0x5851F42D4C957F2D
#: Windows walked and words held at a time.
_WINDOWS, _WORDS = 8192, 1_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def edits_allowed(words: int, share: float = EDIT_SHARE) -> int:
    return int(words * share + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the word sequence that starts at each word."""
    n = max(0, len(codes) - _GRAM + 1)
    out = np.zeros(n, np.uint64)
    for place in range(_GRAM):
        out = _mix(out + codes[place : place + n] * np.uint64(0x9E3779B97F4A7C15))
    return out


@lru_cache(maxsize=1 << 10)
def _plan(size: int, walk: int) -> tuple[list[list[tuple[int, np.uint64]]], np.ndarray]:
    """Random bits of every step of a walk, with the (table, factor) pairs that sample the step."""
    steps, random = 2 * size, np.random.default_rng((size, walk))
    bits = random.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at: list[list[tuple[int, np.uint64]]] = [[] for _ in range(steps)]
    for table in range(TABLES):
        for step in random.choice(steps, min(SAMPLES, steps), replace=False):
            at[step].append((table, random.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
    while not at[-1]:
        at.pop()
    return at, bits


def windows_of(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Windows of `size` words as rows, with 0 for what lies past the end, and a last column of 0."""
    padded = np.concatenate([codes, np.zeros(size + 1, np.uint64)])
    windows = padded[starts[:, None] + np.arange(size + 1)]
    windows[:, size] = 0
    return windows


def walk_keys(windows: np.ndarray, walks: range) -> np.ndarray:
    """LSH keys of windows: a column per walk and table.

    The same window size gives the same random bits and samples, in every process.
    """
    count, size = windows.shape[0], windows.shape[1] - 1
    flat, rows = windows.ravel(), np.arange(count) * (size + 1)
    keys = np.empty((count, len(walks), TABLES), np.uint64)
    for column, walk in enumerate(walks):
        samples, bits = _plan(size, walk)
        sums = np.zeros((TABLES, count), np.uint64)
        at = np.zeros(count, np.int64)
        for step, used in enumerate(samples):
            word = flat[rows + at]
            for table, factor in used:
                sums[table] += _mix(word * factor)
            at += ((word * bits[step]) >> np.uint64(63)).astype(np.int64)
            np.minimum(at, size, out=at)
        for table in range(TABLES):
            keys[:, column, table] = _mix(sums[table] + np.uint64(walk * TABLES + table + 1))
    return keys.reshape(count, len(walks) * TABLES)


def segments_of(words: int) -> list[tuple[int, int]]:
    """Begin and end of the segments of an item; a short item is one segment."""
    parts = max(1, words // SEGMENT_WORDS)
    edges = [words * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def edit_codes(codes: list, edits: int, kind: str, fresh: list, random) -> list:
    """Codes with that many random edits; new words are taken from `fresh`."""
    codes = list(codes)
    for _ in range(edits):
        done = random.choice(("replace", "delete", "insert")) if kind == "mixed" else kind
        at, new = random.randrange(len(codes) + (done == "insert")), random.choice(fresh)
        codes[at : at + (done != "insert")] = [] if done == "delete" else [new]
    return codes


def passage_distance(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """Smallest edit distance of an item to any part of a stretch, and where that part ends.

    Bit-parallel over the item's words; a part may start anywhere.
    """
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    plus, minus, score = full, 0, size
    best = (size, 0)
    for end, word in enumerate(stretch, 1):
        equal = places.get(word, 0)
        vertical = equal | minus
        equal |= (((equal & plus) + plus) ^ plus) & full
        rise = minus | (full & ~(equal | plus))
        fall = plus & equal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        plus = fall | (full & ~(vertical | rise))
        minus = rise & vertical
        if score < best[0]:
            best = (score, end)
    return best


def _order(passage: tuple[int | None, int, int]) -> tuple:
    """By item, unnamed ones last."""
    return passage[0] is None, 0 if passage[0] is None else passage[0]


@dataclass
class LengthClass:
    """Segments of similar length with the sorted LSH keys of their windows.

    `keys` refer to places in `items` and `offsets`: the item of a segment and where in it the
    segment begins. Without walks every surviving window is a candidate for all segments.
    """

    size: int
    needed: int
    walks: int
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray


class ItemIndex:
    """A block of items, searchable in documents."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: float, min_words: int):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, self.edits = [], [], []
        #: Items of few words by their number of words and the words themselves.
        self.short: dict[int, dict[tuple[int, ...], list[int | None]]] = {}
        for name, text in items:
            words = words_of(text)
            if 0 < len(words) < min_words:
                numbers = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
                self.short.setdefault(len(words), {}).setdefault(numbers, []).append(name)
            elif words:
                self.ids.append(name)
                self.words.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                self.edits.append(edits_allowed(len(words), share))
        codes = [self._codes(words) for words in self.words]
        self.grams = np.unique(np.concatenate([_grams(c) for c in codes])) if codes else np.empty(0, np.uint64)
        self.classes: list[LengthClass] = []
        order = sorted(
            ((end - begin, i, begin) for i, c in enumerate(codes) for begin, end in segments_of(len(c))),
        )
        while order:
            size = order[0][0]
            stop = bisect_right(order, size * CLASS_RATIO, key=lambda segment: segment[0])
            members, order = order[:stop], order[stop:]
            parts = [codes[i][begin : begin + length] for length, i, begin in members]
            edits = [edits_allowed(length, share) for length, _, _ in members]
            needed = size - _GRAM + 1 - _GRAM * max(edits)
            walks = self._walks(size, needed, parts, edits)
            own = np.concatenate([windows_of(part, np.zeros(1, np.int64), size) for part in parts])
            keys = walk_keys(own, range(walks))
            place = np.argsort(keys.ravel(), kind="stable")
            flat = np.repeat(np.arange(len(members)), keys.shape[1])[place]
            of = np.array([(i, begin) for _, i, begin in members], np.int32)
            if walks:
                of = of[flat]
            self.classes.append(LengthClass(size, needed, walks, keys.ravel()[place], of[:, 0], of[:, 1]))

    def _walks(self, size: int, needed: int, parts: list[np.ndarray], edits: list[int]) -> int:
        """Walks that find `RECALL` of the segments of a class after as many edits as allowed, or 0.

        Trials stand between foreign words and are found as in a document: windows that survive
        are walked, and any key in common with the segment counts.
        """
        if not any(edits):
            return WALKS
        random = Random(size)
        foreign = int(self._codes_in(np.zeros(1, np.uint64))[0])
        known = self._codes(list(self.vocabulary.values())[:1000]).tolist()
        distinct = self._codes_in(np.arange(1, 1001, dtype=np.uint64) + np.uint64(1 << 40)).tolist()
        line, begins, picked = [], [], []
        for kind in _EDIT_KINDS:
            for trial in range(TRIALS):
                member = random.randrange(len(parts))
                begins.append(len(line))
                picked.append(member)
                fresh = ([foreign], known, distinct)[trial % 3]
                line += [foreign] * size
                line += edit_codes(parts[member].tolist(), edits[member], kind, fresh, random)
        codes = np.array(line + [foreign] * size, np.uint64)
        starts = self._survivors_of(codes, size, needed)
        trials = np.searchsorted(begins, starts, "right") - 1
        picked = np.array(picked)
        windows, own = windows_of(codes, starts, size), np.concatenate(
            [windows_of(part, np.zeros(1, np.int64), size) for part in parts]
        )
        found = np.zeros(len(picked), bool)
        for walk in range(MOST_WALKS):
            left = np.flatnonzero(~found[trials])
            keys = walk_keys(windows[left], range(walk, walk + 1))
            hits = (keys == walk_keys(own, range(walk, walk + 1))[picked[trials[left]]]).any(axis=1)
            found[trials[left[hits]]] = True
            if walk + 1 >= WALKS and found.reshape(len(_EDIT_KINDS), -1).mean(axis=1).min() >= RECALL:
                return walk + 1
        return 0

    @staticmethod
    def _codes(words: list[int]) -> np.ndarray:
        return _mix(np.array(words, np.uint64) * _WORD_FACTOR)

    @staticmethod
    def _codes_in(words: np.ndarray) -> np.ndarray:
        """Codes of the words of a document, of which 0 and those above the vocabulary are foreign."""
        return np.where(
            (words > 0) & (words < np.uint64(1 << 40)), _mix(words * _WORD_FACTOR), _mix(np.uint64(_FOREIGN) + words)
        )

    def _covered(self, codes: np.ndarray) -> np.ndarray:
        """How many word sequences before each place are in an item."""
        grams = _grams(codes)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.concatenate([[0], np.cumsum(self.grams[place] == grams)])

    def _survivors_of(
        self, codes: np.ndarray, size: int, needed: int, covered: np.ndarray | None = None
    ) -> np.ndarray:
        """Starts of windows that may hold a segment of a class."""
        covered = self._covered(codes) if covered is None else covered
        last = len(covered) - 1
        places = np.flatnonzero(codes[:last])
        return places[covered[np.minimum(places + size - _GRAM + 1, last)] - covered[places] >= needed]

    def _survivors(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Starts of windows that may hold an item, by length class."""
        covered = self._covered(codes)
        for group in self.classes:
            yield self._survivors_of(codes, group.size, group.needed, covered)

    def _verify(self, words: list[int], pairs: Iterable[tuple[int, int]]) -> list[tuple[int | None, int, int]]:
        """Best passage of each item around its candidate starts, given in order."""
        stretches: dict[int, list[list[int]]] = {}
        for item, start in pairs:
            # A segment's window and the words before it may both be shifted by the edits.
            size, slack = len(self.words[item]), self.edits[item]
            shift = slack * (1 + (size >= 2 * SEGMENT_WORDS))
            begin, end = max(0, start - shift), start + size + slack + shift
            known = stretches.setdefault(item, [])
            if known and begin <= known[-1][1]:
                known[-1][1] = max(known[-1][1], end)
            else:
                known.append([begin, end])
        best: dict[int, tuple[int, int]] = {}
        for item, known in stretches.items():
            for begin, end in known:
                distance, last = passage_distance(self.words[item], words[begin:end])
                if distance <= self.edits[item]:
                    best[item] = min(best.get(item, (self.edits[item] + 1, 0)), (distance, begin + last - 1))
                if distance == 0:
                    break
        return [(self.ids[item], *found) for item, found in sorted(best.items())]

    def _search_some(self, texts: dict[int, list[int]]) -> dict[int, list[tuple[int | None, int, int]]]:
        """Passages of some documents whose windows are walked together.

        The documents follow one another in one array. Behind each one are as many zeros as the
        longest window has words, so no window reaches into the next document.
        """
        gap = [0] * (self.classes[-1].size + _GRAM) if self.classes else []
        numbers, begins, line = [], [], []
        for number, words in texts.items():
            numbers.append(number)
            begins.append(len(line))
            line += words
            line += gap
        if not numbers:
            return {}
        words = np.array(line, np.uint64)
        codes = self._codes_in(words)
        codes[self._gaps(begins, texts, len(line))] = 0
        pairs: dict[int, set[tuple[int, int]]] = {}
        for group, starts in zip(self.classes, self._survivors(codes), strict=True):
            for at in range(0, len(starts), _WINDOWS):
                block = starts[at : at + _WINDOWS]
                if group.walks:
                    keys = walk_keys(windows_of(codes, block, group.size), range(group.walks))
                    low = np.searchsorted(group.keys, keys.ravel(), "left")
                    high = np.searchsorted(group.keys, keys.ravel(), "right")
                    hits = [(p // keys.shape[1], low[p], high[p]) for p in np.flatnonzero(high > low)]
                else:
                    hits = [(p, 0, len(group.items)) for p in range(len(block))]
                for place, first, end in hits:
                    start = int(block[place])
                    doc = bisect_right(begins, start) - 1
                    pairs.setdefault(doc, set()).update(
                        (item, start - begins[doc] - offset)
                        for item, offset in zip(
                            group.items[first:end].tolist(), group.offsets[first:end].tolist(), strict=True
                        )
                    )
        return {numbers[d]: self._verify(texts[numbers[d]], sorted(found)) for d, found in pairs.items()}

    @staticmethod
    def _gaps(begins: list[int], texts: dict[int, list[int]], size: int) -> np.ndarray:
        """Where no word stands."""
        edge = np.zeros(size + 1, np.int8)
        np.add.at(edge, begins, 1)
        np.add.at(edge, [b + len(w) for b, w in zip(begins, texts.values(), strict=True)], -1)
        return np.cumsum(edge[:-1]) == 0

    def _search_short(self, words: list[int]) -> list[tuple[int | None, int, int]]:
        """First exact passage of every short item."""
        found = []
        for size, items in self.short.items():
            seen: dict[tuple[int, ...], int] = {}
            for last, part in enumerate(zip(*(words[i:] for i in range(size)), strict=False), size - 1):
                if part in items:
                    seen.setdefault(part, last)
            found += [(name, 0, last) for part, last in seen.items() for name in items[part]]
        return sorted(found, key=_order)

    def search(self, texts: Iterable[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """(item id, distance, last word) of the best passage of every item, for each text."""
        get = self.vocabulary.get
        out: list[list] = []
        some: dict[int, list[int]] = {}
        held = 0
        for number, text in enumerate(texts):
            words = [get(w, 0) for w in words_of(text)] if self.vocabulary else []
            out.append(self._search_short(words) if self.short else [])
            if self.ids and len(words) >= _GRAM and any(words):
                some[number] = words
                held += len(words)
            if held > _WORDS:
                for found, passages in self._search_some(some).items():
                    out[found] = sorted(out[found] + passages, key=_order)
                some, held = {}, 0
        for found, passages in self._search_some(some).items():
            out[found] = sorted(out[found] + passages, key=_order)
        return out


def block_count(items: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks of about `block_bytes` that the text of all items makes."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return -(-size // block_bytes)


def item_block(items: DataFrame, item: str, text: str, block: int, blocks: int) -> list:
    """Items of one block, in order. Rows with one text are in one block."""
    number = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(blocks))
    rows = items.filter(number == block).select(item, text).collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (*_order((r[0], 0, 0)), r[1] or ""))


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    share: float = EDIT_SHARE,
    min_words: int = MIN_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with `passages`: an array of (item, distance, last_word), by block and item.

    One entry for every item with a passage in the document: its smallest distance found and the
    number of the passage's last word. Items of up to `block_bytes` of text are searched as documents
    are read: nothing is written or shuffled. More items make several blocks, of which the driver and
    the tasks hold one at a time: documents are written once, each block reads them and writes what it
    finds, and the few documents with a passage are looked up at the end. Each text is searched whole. Null and empty texts, and tables
    without items, give empty arrays; items without words are left out; items of fewer than
    `min_words` words are found as exact word sequences; repeated items are each reported. Other columns pass through, one called
    `passages` is replaced.
    """
    ship(docs.sparkSession)
    plain = docs.drop("passages") if text != "passages" else docs
    kind = f"array<struct<item:{items.schema[item].dataType.simpleString()},distance:int,last_word:int>>"

    def searcher(index: ItemIndex):
        @F.pandas_udf(kind)
        def search(texts: pd.Series) -> pd.Series:
            names = ("item", "distance", "last_word")
            found = index.search(texts)
            return pd.Series([[dict(zip(names, p, strict=True)) for p in passages] for passages in found])

        return search

    def passages_of(block: int) -> Column:
        index = ItemIndex(item_block(items, item, item_text, block, blocks), share, min_words)
        return searcher(index)(F.col(text))

    blocks = block_count(items, item_text, block_bytes)
    if blocks <= 1:
        return plain.withColumn("passages", passages_of(0) if blocks else F.array().cast(kind))
    tables = Workspace(docs.sparkSession)
    row = "_row"
    while row in plain.columns:
        row += "_"
    rows = tables.write(plain.withColumn(row, F.monotonically_increasing_id()))
    found = None
    for block in range(blocks):
        some = rows.select(row, F.lit(block).alias("block"), passages_of(block).alias("found")).filter(F.size("found") > 0)
        some = tables.write(some)
        found = some if found is None else found.unionByName(some)
    # At most one entry per block for a document; as text, their size can be measured.
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "found"))), lambda e: e["found"]))
    hits = materialize(found.groupBy(row).agg(F.to_json(entries).alias("_hits")))
    joined = lookup_join(rows, hits, row, "left")
    columns = [c for c in plain.columns if c != "passages"]
    return joined.select(*columns, F.coalesce(F.from_json("_hits", kind), F.array().cast(kind)).alias("passages"))
