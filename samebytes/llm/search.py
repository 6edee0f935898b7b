"""Ranked lexical search of many items at once, sharing partial sums between them.

A score is a sum over an item's terms, so items with terms in common have partial sums in common:

1. Terms that the same items hold, equally often, are one atom. Its accumulator is the partial score
   of a document over all of them.
2. The pair of nodes that most items still have in common becomes a node of its own, again and again,
   until no two items share a pair. Items then are sums over a graph in which a shared part stands once.
3. Every document's accumulators are made once, node by node, and items add up the few nodes that they
   are left with.

Items come in blocks of bounded text, whose graph is sent to tasks. Many blocks share one reading of the
documents, which writes for each its length and how often it holds the terms of all these items; counts
of documents and the scores of each block come from that table. Scores are integers. A task hands on the best documents of
each item that it has seen, and those are ranked in two steps, so that no task gets more than a few
per task before it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from samebytes.llm.common import Workspace, materialize, ship

#: Text of a block of items, which share a graph, and of the items for which documents are read once.
ITEM_BYTES, READ_BYTES = 256 * 1024, 8 * 1024 * 1024
#: Documents whose best are kept for each item.
BEST = 20
#: Nodes of an item, the most shared ones, among which pairs are mined. Others are added one by one.
WIDEST = 24

_NODE_BYTES = 16 * 1024 * 1024  # of the accumulators of the documents that a task works on
_SLICE_WORDS = 1 << 18
_SALTS = 64


def _term_bytes() -> bytes:
    """For each byte what it counts as: ASCII letters and digits and bytes beyond ASCII stay, others separate."""
    kept = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in kept else 0x20 for b in range(256))


_TERM_BYTES = _term_bytes()


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_TERM_BYTES).split() if text else []


def weight(documents: int, having: int) -> int:
    """Weight of a term."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


@dataclass
class QueryGraph:
    """How items are added up. Nodes are numbered: atoms, multiples of atoms, sums of two nodes."""

    terms: list[bytes] = field(default_factory=list)  # those of an atom stand together
    atom_of: list[int] = field(default_factory=list)
    multiples: list[tuple[int, int]] = field(default_factory=list)  # atom, times
    sums: list[tuple[int, int]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)  # nodes

    @property
    def atoms(self) -> int:
        return self.atom_of[-1] + 1 if self.atom_of else 0

    @property
    def nodes(self) -> int:
        return self.atoms + len(self.multiples) + len(self.sums)


def _mine(sets: list[set[int]], fresh: int) -> list[tuple[int, int]]:
    """Replace pairs of nodes that several sets share, most shared ones first; the pairs, numbered from `fresh`."""
    often = Counter(node for nodes in sets for node in nodes)
    open_ = [
        set(sorted((n for n in nodes if often[n] > 1), key=lambda n: (-often[n], n))[:WIDEST]) for nodes in sets
    ]
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for item, nodes in enumerate(open_):
        ordered = sorted(nodes)
        for at, x in enumerate(ordered):
            for y in ordered[at + 1 :]:
                where[x, y].add(item)
    heap = [(-len(items), pair) for pair, items in where.items() if len(items) > 1]
    heapq.heapify(heap)
    sums: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        items = where.get(pair, ())
        if len(items) < 2:
            continue
        if len(items) != -count:
            heapq.heappush(heap, (-len(items), pair))
            continue
        node = fresh + len(sums)
        sums.append(pair)
        del where[pair]
        for item in sorted(items):
            open_[item] -= set(pair)
            sets[item] -= set(pair)
            for other in open_[item]:
                for gone in pair:
                    where[min(gone, other), max(gone, other)].discard(item)
                where[other, node].add(item)
            open_[item].add(node)
            sets[item].add(node)
        # Only pairs with the new node have gained items.
        partners = {other for item in items for other in open_[item] if other != node}
        for other in sorted(partners):
            if len(where[other, node]) > 1:
                heapq.heappush(heap, (-len(where[other, node]), (other, node)))
    return sums


def plan_queries(items: list[list[bytes]]) -> QueryGraph:
    """The graph for items given as their terms with repeats."""
    holders: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for item, terms in enumerate(items):
        for term, times in sorted(Counter(terms).items()):
            holders[term].append((item, times))
    atoms: dict[tuple, list[bytes]] = defaultdict(list)
    for term in sorted(holders):
        atoms[tuple(holders[term])].append(term)
    graph = QueryGraph()
    sets: list[set[int]] = [set() for _ in items]
    for atom, (holding, terms) in enumerate(atoms.items()):
        graph.terms += terms
        graph.atom_of += [atom] * len(terms)
        scaled: dict[int, int] = {1: atom}
        for item, times in holding:
            if times not in scaled:
                scaled[times] = len(atoms) + len(graph.multiples)
                graph.multiples.append((atom, times))
            sets[item].add(scaled[times])
    graph.sums = _mine(sets, len(atoms) + len(graph.multiples))
    graph.items = [sorted(nodes) for nodes in sets]
    return graph


def count_terms(rows: DataFrame, kind: str, terms: list[bytes]) -> DataFrame:
    """`id`, `n`, and the numbers (`terms`) and counts (`times`) of the given terms, of documents with any term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(terms)}
        size = max(1, len(terms))

        def done(keys: list, counts: list[int], flat: list[int], type_: pa.DataType) -> pa.RecordBatch:
            numbers = np.array(flat, np.int64)
            row = np.repeat(np.arange(len(keys)), counts)[numbers >= 0]
            pairs, times = np.unique(row * size + numbers[numbers >= 0], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(1, len(keys) + 1) * size)
            numbers, times = (pairs % size).astype("<u4"), times.astype("<u4")
            begins = [0, *ends[:-1]]
            columns = [[a[x:y].tobytes() for x, y in zip(begins, ends, strict=True)] for a in (numbers, times)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, type_), pa.array(counts, pa.int64()), *[pa.array(c, pa.binary()) for c in columns]],
                names=["id", "n", "terms", "times"],
            )

        for batch in batches:
            keys, counts, flat, type_ = [], [], [], batch.schema.field("id").type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for key, text in zip(part.column("id").to_pylist(), texts, strict=True):
                    found = terms_of(text)
                    if found:
                        keys.append(key)
                        counts.append(len(found))
                        flat += [number.get(term, -1) for term in found]
                if len(flat) > _SLICE_WORDS:
                    yield done(keys, counts, flat, type_)
                    keys, counts, flat = [], [], []
            if keys:
                yield done(keys, counts, flat, type_)

    return rows.mapInArrow(work, f"id {kind}, n bigint, terms binary, times binary")


def _having(counted: DataFrame, size: int) -> DataFrame:
    """`term` and the number of documents that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held = b"".join(batch.slice(at, 256).column("terms").to_pylist())
                total += np.bincount(np.frombuffer(held, "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "having"])

    held = counted.select("terms").mapInArrow(work, "term bigint, having bigint")
    return held.groupBy("term").agg(F.sum("having").alias("having"))


class _Best:
    """The best documents of every item so far: score, then id; a null id comes last."""

    def __init__(self, items: int, best: int):
        self.items, self.best = items, best
        self.floor = np.ones(items, np.int64)  # scores below it no longer matter
        self.rows: list[tuple] = []

    def add(self, scores: np.ndarray, keys: list) -> None:
        items, places = np.nonzero(scores >= self.floor[:, None])
        found = scores[items, places].tolist()
        self.rows += [
            (item, -score, keys[place] is None, keys[place])
            for item, score, place in zip(items.tolist(), found, places.tolist(), strict=True)
        ]
        if len(self.rows) > 4 * self.items * self.best:
            self.trim()

    def trim(self) -> None:
        # Rows that tie in all but a null id are the same.
        self.rows.sort(key=lambda r: r[:3] if r[2] else r)
        kept, item, count = [], None, 0
        for row in self.rows:
            count = count + 1 if row[0] == item else 1
            item = row[0]
            if count <= self.best:
                kept.append(row)
                if count == self.best:
                    self.floor[item] = -row[1]
        self.rows = kept


def _scores(graph: QueryGraph, atoms: np.ndarray, weights: np.ndarray, documents: int, terms_in_all: int,
            ends: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Scores of some documents (columns) for all items (rows). `atoms` has the atom of each term, or -1."""
    many = len(lengths)
    row = np.repeat(np.arange(many), np.diff(ends, prepend=0))
    own = np.flatnonzero(atoms[terms] >= 0)
    row, terms, times = row[own], terms[own], times[own]
    m = 75 + (25 * lengths * documents) // terms_in_all
    value = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))
    key = row * graph.atoms + atoms[terms]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    nodes = np.zeros((graph.nodes, many), np.int64)
    if len(first):
        nodes[key[first] % graph.atoms, key[first] // graph.atoms] = np.add.reduceat(value, first)
    node = graph.atoms
    for atom, count in graph.multiples:
        np.multiply(nodes[atom], count, out=nodes[node])
        node += 1
    for x, y in graph.sums:
        np.add(nodes[x], nodes[y], out=nodes[node])
        node += 1
    scores = np.zeros((len(graph.items), many), np.int64)
    for item, parts in enumerate(graph.items):
        for part in parts:
            scores[item] += nodes[part]
    return scores


def _best_of_tasks(counted: DataFrame, graph: QueryGraph, atoms: np.ndarray, weights: np.ndarray,
                   totals: tuple[int, int], keys: pa.Array, kinds: tuple[str, str], best: int) -> DataFrame:
    """The best documents of each item and task: `row` (number of the item), `item`, `id` and `score`."""
    step = max(16, min(1024, _NODE_BYTES // (8 * max(1, graph.nodes))))
    item_kind, id_kind = kinds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, type_ = _Best(len(graph.items), best), None
        for batch in batches:
            type_ = batch.schema.field("id").type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held = part.column("terms").to_pylist()
                ends = np.cumsum([len(t) // 4 for t in held])
                numbers = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
                times = np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
                lengths = part.column("n").to_numpy(zero_copy_only=False)
                top.add(_scores(graph, atoms, weights, *totals, ends, lengths, numbers, times), part.column("id").to_pylist())
        if top.rows:
            top.trim()
            rows = pa.array([r[0] for r in top.rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows, keys.take(rows), pa.array([r[3] for r in top.rows], type_), pa.array([-r[1] for r in top.rows], pa.int64())],
                names=["row", "item", "id", "score"],
            )

    return counted.mapInArrow(work, f"row int, item {item_kind}, id {id_kind}, score bigint")


def _ranked(scored: DataFrame, best: int) -> DataFrame:
    """The first rows of each item: among those of some tasks, then of all."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = scored.withColumn("salt", F.spark_partition_id() % _SALTS)
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*order)))
    every = some.filter(F.col("rank") <= best).drop("rank", "salt")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
    return ranked.filter(F.col("rank") <= best).select("item", "rank", "id", "score")


def _blocks(items: list[tuple], item_bytes: int) -> Iterator[list[tuple]]:
    """Items that have terms, in blocks of about `item_bytes` of them."""
    block, held = [], 0
    for item, terms in items:
        size = sum(map(len, terms)) + len(terms)
        if block and held + size > item_bytes:
            yield block
            block, held = [], 0
        if terms:
            block.append((item, terms))
            held += size
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", best: int = BEST,
    item_bytes: int = ITEM_BYTES, read_bytes: int = READ_BYTES,
) -> DataFrame:
    """The `best` documents of each item: the item's id, `rank` from 1, the document's id and `score`.

    Terms are stretches of ASCII letters and digits and of characters beyond ASCII, with A-Z
    lower-cased. Documents whose score is above 0 are ranked by score, then by id; a document without id
    comes last among equals. Each row of `docs` is a document, so a repeated one is ranked
    repeatedly; null and empty texts have no terms, are not counted and never found. Of equal rows of
    `items` one counts; rows of one id with different texts are ranked one by one, under that id. An
    item without terms or without any document finds nothing, a null item id stays null. Texts of any
    length are read whole. Other columns of both tables are left out, so their names do not matter.
    Either table may be empty, which gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct()
    kinds = (asked.schema["item"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())
    arrow = to_arrow_type(asked.schema["item"].dataType)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    readings = max(1, math.ceil(size / read_bytes))
    tables = Workspace(spark)
    found: list[DataFrame] = []
    for reading in range(readings):
        # About `read_bytes` of text, or one item.
        own = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(readings)) == reading).collect()
        parsed = [(r.item, terms_of((r.text or "").encode())) for r in own]
        vocabulary = {term: i for i, term in enumerate(dict.fromkeys(t for _, terms in parsed for t in terms))}
        if not vocabulary:
            continue
        counted = tables.write(count_terms(rows, kinds[1], list(vocabulary)))
        documents, terms_in_all = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        weights = np.array([weight(documents, 0)] * len(vocabulary), np.int64)
        for r in _having(counted, len(vocabulary)).collect():
            weights[r.term] = weight(documents, r.having)
        for block in _blocks(parsed, item_bytes):
            graph = plan_queries([terms for _, terms in block])
            atoms = np.full(len(vocabulary), -1, np.int64)
            atoms[[vocabulary[term] for term in graph.terms]] = graph.atom_of
            keys = pa.array([item for item, _ in block], arrow)
            scored = _best_of_tasks(counted, graph, atoms, weights, (documents, terms_in_all), keys, kinds, best)
            found.append(tables.write(_ranked(scored, best)))
    if found:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
    else:
        out = spark.createDataFrame([], f"item {kinds[0]}, rank int, id {kinds[1]}, score bigint")
    out = materialize(out)
    tables.drop()
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")
