"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Its sketch has `REGISTERS` registers; register i is
the truncated logarithm, to a base just above 1, of the smallest of the exponentially
distributed hashes of its shingles. Registers of a union are the larger ones of two sketches, so
sketches merge, and two sets agree in a register with about their Jaccard similarity.

Bands of registers are bucketed. Candidates of a bucket are not all of its pairs:

1. Documents with the same set are one class, represented by its smallest id.
2. Every class is compared with the smallest leader of its buckets, one candidate per class.
3. In buckets that still hold several components, the classes outside the bucket's main
   component are compared with one member of it per bucket.
4. In buckets that still hold several components, no candidate may be left open but those within
   one component, where a link changes nothing. Jaccard distance is a metric, and the exact
   similarity of every class in such a bucket to a central member of the main component is
   known, so most classes that met the component by chance are ruled out without a comparison.
   The others are compared with all members in blocks, inside the tasks, and only links are
   returned. Classes outside the main component that met each other are compared as pairs.

A candidate is first estimated jointly from both sketches by maximum likelihood and goes if its
estimate is five deviations below the limit. The rest is confirmed on the full sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import materialize, ship, slices
from samebytes.llm.components import connected_components
from samebytes.operators.scale import lookup_join

#: Bands and registers per band. A pair with similarity 0.8 shares a band with probability
#: 1 - (1 - 0.8**6)**42 > 0.999997.
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Base, rate and number of values of a register of two bytes.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2

#: Shingles of a block of step 4, and documents that are sent one copy of the set they are compared with.
BLOCK_SHINGLES, BLOCK_MEMBERS = 8192, 64

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {upper: upper + 32 for upper in range(65, 91)}
_MASK = (1 << 64) - 1
_MEMO = 1 << 16


def words_of(text: str | None) -> list[str]:
    """Words of a text, with A-Z lower-cased."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.known
        if len(known) > _MEMO:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        size = min(self.size, len(words))
        hashes = self._hashes(words)
        count = len(words) - size + 1
        out = np.full(count, size, np.uint64)
        for place in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[place : place + count])
        return np.unique(out)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    odd = random.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


_FACTORS, _OFFSETS = _multipliers()


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set; blocks of shingles are merged, so any size takes the same memory."""
    low = np.full(REGISTERS, (1 << 32) - 1, np.uint32)
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(keys), 1024):
        hashed = np.multiply.outer(keys[at : at + 1024], _FACTORS)
        hashed += _OFFSETS
        np.minimum(low, hashed.min(axis=0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    values = np.floor(1 - np.log(exponential) / np.log(BASE))
    return np.clip(values, 0, TOP + 1).astype("<u2")


def joint_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimate of Jaccard similarities from pairs of sketches (rows) and set sizes.

    The likelihood is that of the number of registers in which the left one is larger, the right
    one is larger, or both are equal; it is concave, and a golden section search finds its top.
    """
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    scale, log_base = (BASE - 1) / BASE, np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        over = np.clip(-np.log1p(-(u - v * j) * scale) / log_base, 1e-12, 1)
        under = np.clip(-np.log1p(-(v - u * j) * scale) / log_base, 1e-12, 1)
        both = np.clip(1 - over - under, 1e-12, 1)
        return more * np.log(over) + less * np.log(under) + same * np.log(both)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(40):
        span = (high - low) * golden
        first, second = high - span, low + span
        rising = likelihood(first) < likelihood(second)
        low, high = np.where(rising, first, low), np.where(rising, high, second)
    return (low + high) / 2


def sketch_documents(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """`id`, `n_shingles`, `digest` of the set and `registers` of every row; null for empty sets."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch):
                sets = [shingler(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers_of(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["id", "n_shingles", "digest", "registers"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"id {kind}, n_shingles bigint, digest binary, registers binary")


def full_sets(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """`id` and `shingles`, the sorted set as bytes."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch):
                sets = [shingler(text).tobytes() for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(shingle, f"id {rows.schema['id'].dataType.simpleString()}, shingles binary")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose joint estimate does not rule them out."""
    limit = percent / 100
    floor = limit - 5 * (limit * (1 - limit) / REGISTERS) ** 0.5

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(a), "<u2").reshape(len(a), -1)
        right = np.frombuffer(b"".join(b), "<u2").reshape(len(b), -1)
        return pd.Series(joint_similarity(left, right, n_a.to_numpy(float), n_b.to_numpy(float)))

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}")
        )

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fitting = joined.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return fitting.filter(estimate("r_a", "r_b", "n_a", "n_b") >= floor).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the size of the intersection (`common`) and of the union (`all`) of their full sets.

    Each `b` is sent once to every block of the documents `a` that are compared with it, ahead of them.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"))
    blocks = materialize(counts)
    asked = pairs.join(blocks, "b").select(
        F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("leads")
    )
    leads = blocks.select(
        F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("leads")
    )
    dealt = asked.unionByName(leads).join(sets, "id").repartition("b", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, leaders = None, []
        for batch in batches:
            for part in slices(batch):
                found: list[tuple] = []
                columns = [part.column(c).to_pylist() for c in ("b", "block", "leads", "id", "shingles")]
                for b, block, first, a, shingles in zip(*columns, strict=True):
                    own = np.frombuffer(shingles, np.uint64)
                    if (b, block) != place:
                        place, leaders = (b, block), []
                    if first:
                        leaders.append(own)
                        continue
                    for leader in leaders:
                        where = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
                        common = int((leader[where] == own).sum())
                        found.append((a, b, common, len(leader) + len(own) - common))
                ids = part.schema.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], t) for i, t in enumerate((ids, ids, pa.int64(), pa.int64()))],
                    names=["a", "b", "common", "all"],
                )

    ordered = dealt.sortWithinPartitions("b", "block", F.desc("leads"))
    return ordered.mapInArrow(compare, f"a {kind}, b {kind}, common bigint, all bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the limit."""
    return _compared(pairs, sets).filter(100 * F.col("common") >= percent * F.col("all")).select("a", "b")


def _near_pivot(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of mixed buckets with their similarity `s` to the pivot of the bucket's main component.

    The pivot is the member that occurs in most of the buckets.
    """
    often = mixed.groupBy("component", "id").agg(F.count(F.lit(1)).alias("times"))
    pivots = materialize(
        often.groupBy("component").agg(F.min(F.struct((-F.col("times")).alias("times"), "id"))["id"].alias("b"))
        .withColumnRenamed("component", "main")
    )
    wanted = materialize(mixed.select(F.col("id").alias("a"), "main").distinct())
    pairs = materialize(wanted.join(pivots, "main"))
    # Where one id has several texts, the range of its similarities counts.
    ratio = F.col("common") / F.col("all")
    known = _compared(pairs.select("a", "b").distinct(), sets).groupBy("a", "b").agg(
        F.min(ratio).alias("low"), F.max(ratio).alias("high")
    )
    near = materialize(pairs.join(materialize(known), ["a", "b"]).select(F.col("a").alias("id"), "main", "low", "high"))
    return materialize(mixed.join(near, ["id", "main"]))


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with theirs and the bucket's main one."""
    known = components.withColumnRenamed("component", "known")
    tagged = materialize(
        members.join(known, "id", "left").select("key", "id", "n_shingles", F.coalesce("known", "id").alias("component"))
    )
    sizes = tagged.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    buckets = materialize(
        sizes.groupBy("key").agg(
            F.max(F.struct("size", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")
        ).filter("parts > 1").drop("parts")
    )
    return materialize(tagged.join(buckets, "key"))


def _linked_in_blocks(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the classes outside a main component that are near it, and all that is near it.

    Both sides are dealt into blocks of about `BLOCK_SHINGLES`, and a task compares one block with
    one block. What is sent grows with the number of blocks, not of pairs.
    """
    near = materialize(
        mixed.filter("inside OR near").select("main", "id", "component", "inside", "n_shingles").distinct()
    )
    asking = near.filter("NOT inside")
    blocks = lambda rows, name: rows.groupBy("main").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias(name)
    )
    grid = materialize(blocks(near, "columns").join(blocks(asking, "rows"), "main"))
    place = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asked = near.join(grid, "main").select("main", every("rows").alias("row"), place("columns").alias("column"), "id", "component", F.lit(False).alias("asks"))
    asks = asking.join(grid, "main").select("main", place("rows").alias("row"), every("columns").alias("column"), "id", "component", F.lit(True).alias("asks"))
    dealt = asked.unionByName(asks).join(sets, "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        data, queries = group[~group.asks], group[group.asks]
        out: list[tuple[int, int]] = []
        if len(data) and len(queries):
            rows = [np.frombuffer(s, np.uint64) for s in data.shingles]
            flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, components = data.id.to_numpy(), data.component.to_numpy()
            for id_, component, shingles in zip(queries.id, queries.component, queries.shingles, strict=True):
                own = np.frombuffer(shingles, np.uint64)
                where = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[where] == flat).astype(np.int64), begins)
                hit = (100 * common >= percent * (sizes + len(own) - common)) & (components != component)
                out += [(id_, other) for other in ids[hit]]
        return pd.DataFrame(out, columns=["a", "b"])

    kind = near.schema["id"].dataType.simpleString()
    return dealt.groupBy("main", "row", "column").applyInPandas(compare, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `docs`: the id, `n_shingles`, `component_id` and `kept`.

    Documents are linked when 100 * intersection >= `percent` * union of their sets of `size`-word
    shingles; shorter texts have their whole sequence as one shingle. `component_id` is the
    smallest id reachable over links, and `kept` tells whether it is the row's own. Null and empty
    texts and texts without words have an empty set and no link. Rows with one id are one
    document, linked through each of their texts. Rows without id have a null component, have no
    links and are kept. Other columns are left out. An empty table gives an empty one.
    """
    sketches = materialize(sketch_documents(docs, id, text, size))
    usable = sketches.filter(F.col("id").isNotNull() & F.col("digest").isNotNull())
    copies = materialize(
        usable.groupBy("digest").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        )
    )
    classes = copies.drop("digest")
    keys = F.array(
        *[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]
    )
    banded = classes.select("id", "n_shingles", F.explode(keys).alias("key"))
    buckets = materialize(
        banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
        .filter("leader != last").drop("last")
    )
    members = materialize(banded.join(buckets, "key"))
    active = materialize(members.select("id").distinct())
    texts = lookup_join(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), active, "id")
    sets = materialize(full_sets(texts, "id", "text", size))
    active_classes = materialize(classes.join(active, "id"))

    def links(pairs: DataFrame) -> DataFrame:
        likely = materialize(_likely(materialize(pairs.distinct()), active_classes, percent))
        return materialize(_confirmed(likely, sets, percent))

    found = links(
        members.groupBy("id").agg(F.min("leader").alias("b")).filter("id != b").select(F.col("id").alias("a"), "b")
    )
    components = connected_components(found)
    mixed = _mixed(members.drop("leader"), components)
    chosen = mixed.filter("component = main").groupBy("key").agg(
        F.min(F.struct(F.xxhash64("key", "id").alias("place"), F.col("id").alias("id")))["id"].alias("b")
    )
    outside = mixed.filter("component != main")
    found = materialize(found.unionByName(links(outside.join(materialize(chosen), "key").select(F.col("id").alias("a"), "b"))))
    components = connected_components(found)
    mixed = _mixed(mixed.select("key", "id", "n_shingles"), components)
    mixed = _near_pivot(mixed, sets)
    slack = 1 - percent / 100 + 1e-9
    least = materialize(mixed.filter("component = main").groupBy("main").agg(F.min("low").alias("least")))
    mixed = materialize(
        mixed.join(least, "main").withColumn("inside", F.col("component") == F.col("main"))
        .withColumn("near", F.col("high") >= F.col("least") - slack).drop("least")
    )
    found = found.unionByName(materialize(_linked_in_blocks(mixed, sets, percent)))

    def side(name: str) -> DataFrame:
        columns = ("id", "n_shingles", "component", "low", "high", "near")
        return mixed.filter("NOT inside").select("key", *[F.col(c).alias(f"{c}_{name}") for c in columns])

    apart = F.greatest(F.col("low_a") - F.col("high_b"), F.col("low_b") - F.col("high_a"))
    rest = side("a").join(side("b"), "key").filter(
        (F.col("id_a") < F.col("id_b"))
        & (F.col("component_a") != F.col("component_b"))
        & ~(F.col("near_a") & F.col("near_b"))
        & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        & (apart <= slack)
    )
    found = found.unionByName(links(rest.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    # One id with several texts stands in several classes; all of them are one document.
    several = usable.groupBy("id").agg(
        F.min(F.xxhash64("digest")).alias("least"), F.max(F.xxhash64("digest")).alias("most")
    ).filter("least != most").select(F.col("id").alias("a"))
    own = usable.join(materialize(several), usable["id"] == F.col("a"), "left_semi").select(F.col("id").alias("a"), "digest")
    found = found.unionByName(own.join(copies.select("digest", F.col("id").alias("b")), "digest").select("a", "b"))
    components = connected_components(found)
    labelled = copies.select("digest", "id").join(components, "id", "left")
    by_set = materialize(labelled.select("digest", F.coalesce("component", "id").alias("component_id")))
    out = lookup_join(sketches.filter("digest IS NOT NULL AND id IS NOT NULL"), by_set, "digest")
    alone = sketches.filter("digest IS NULL OR id IS NULL").withColumn("component_id", F.col("id"))
    columns = ["id", "n_shingles", "component_id"]
    both = out.select(*columns).unionByName(alone.select(*columns))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return both.select(F.col("id").alias(id), "n_shingles", "component_id", kept.alias("kept"))
