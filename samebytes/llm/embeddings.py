"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random onto blocks of eight dimensions, shifted, and every block
is decoded to the nearest point of the E8 lattice. The points of a table's blocks are a cell. A
vector is filed under its own cell in each of several tables and looked up in its own and in
neighbouring cells: those that one block reaches by a step to a neighbouring lattice point, nearest
first. Pairs that meet are verified by cosine in double precision.

Pairs are not listed. Each vector joins the cluster of the smallest vector filed in one of its cells
that it is verified to be near to, or is one of its own. Where vectors of two clusters meet in a cell,
the two clusters are compared as a whole, in blocks inside tasks, and so is every cluster with itself.
A task returns how many links each vector has and one link that ties it to the others, so a dense group
of near vectors costs its square in multiplications, not in rows. What is a cluster has no influence on
the result, as all pairs that meet are compared. Only pairs of clusters are rows: where a cell is crowded
by vectors that are far apart, more `BLOCKS` keep it small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import materialize, ship, slices
from samebytes.llm.components import connected_components
from samebytes.operators.scale import lookup_join

#: Tables, lattice blocks per cell, probed cells per block beside the own one.
TABLES, BLOCKS, PROBES = 6, 2, 3
#: Width of a lattice step in units of the projected length; suits a cosine of 0.98.
WIDTH = 1.8
MIN_COSINE = 0.98
#: Vectors of a cluster that are compared at a time.
BLOCK_VECTORS = 64


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _decode_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if odd, round the worst the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even-sum integers, or those shifted by one half."""
    whole, half = _decode_even(x), _decode_even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


@lru_cache(maxsize=64)
def _projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(size)
    shape = TABLES * BLOCKS * 8
    return random.normal(0, 1, (size, shape)) / WIDTH, random.uniform(0, 2, shape)


def _hash(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hash of lattice points (last axis), in half steps."""
    out = salt.astype(np.uint64)
    for place in range(8):
        value = np.rint(points[..., place] * 2).astype(np.int64).astype(np.uint64)
        out = (out ^ value) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def cells(unit: np.ndarray, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (vector, table) and probed cells (vector, table, probe), the own one first."""
    probes = PROBES if probes is None else probes
    n, size = unit.shape
    project, shift = _projection(size)
    at = (unit @ project + shift).reshape(-1, 8)
    own = decode(at)
    salt = np.tile(np.arange(1, TABLES * BLOCKS + 1, dtype=np.uint64), n)
    own_hash = _hash(own, salt).reshape(n, TABLES, BLOCKS)
    total = own_hash.sum(axis=2)
    found = [total[:, :, None]]
    if probes:
        steps = neighbours()
        # Of all vectors one step away, the nearest have the largest product with the residual.
        best = np.argpartition((own - at) @ steps.T, probes, axis=1)[:, :probes]
        near = own[:, None, :] + steps[best]
        near_hash = _hash(near, np.repeat(salt[:, None], probes, axis=1)).reshape(n, TABLES, BLOCKS, probes)
        # A probe moves one block or none.
        found.append((total[:, :, None, None] - own_hash[..., None] + near_hash).reshape(n, TABLES, -1))
    return total.astype(np.int64), np.concatenate(found, axis=2).astype(np.int64)


def usable(vector) -> bool:
    """Whether a vector can be linked at all: not null, not zero, all components finite."""
    if vector is None or not len(vector):
        return False
    values = np.asarray(vector, dtype=object)
    if any(v is None for v in values):
        return False
    numbers = values.astype(np.float64)
    return bool(np.isfinite(numbers).all() and numbers.any())


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    rows = np.array(vectors, np.float64)
    # Dividing by the largest component first keeps squares in range.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def _vectors(part: pa.RecordBatch, name: str = "vec") -> list[np.ndarray]:
    """Vectors of a batch in double precision; none is null or holds one."""
    column = part.column(name)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), ends[:-1])


def cell_keys(classes: DataFrame, keep: str, probed: bool) -> DataFrame:
    """`key` of every cell that vectors are filed in, or else probe, with a column of theirs.

    `seed` tells labels apart, and so does the number of components; tables have salts of their own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                vectors, seeds = _vectors(part), part.column("seed").to_numpy()
                sizes = np.array([len(v) for v in vectors])
                keys, rows = [], []
                for size in np.unique(sizes):
                    some = np.flatnonzero(sizes == size)
                    own, near = cells(_units([vectors[i] for i in some]), PROBES if probed else 0)
                    found = near[:, :, 1:].reshape(len(some), -1) if probed else own
                    keys.append((found ^ seeds[some][:, None] ^ np.int64(size)).ravel())
                    rows.append(np.repeat(some, found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), part.column(keep).take(pa.array(np.concatenate(rows)))], names=["key", keep]
                )

    return classes.select("seed", "vec", keep).mapInArrow(work, f"key bigint, {keep} bigint")


def _linked(rows: np.ndarray, columns: np.ndarray, min_cosine: float) -> np.ndarray:
    """Which unit vectors of two blocks are near each other."""
    return rows @ columns.T >= min_cosine


def _least_reachable(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that each row and each column reaches over links between them."""
    none = max(left.max(), right.max()) + 1
    while True:
        up = np.minimum(left, np.where(hit, right[None, :], none).min(axis=1))
        down = np.minimum(right, np.where(hit, up[:, None], none).min(axis=0))
        if (up == left).all() and (down == right).all():
            return up, down
        left, right = up, down


def _compared(members: DataFrame, pairs: DataFrame, min_cosine: float) -> DataFrame:
    """`node`, `others` (linked vectors) and `root` (a node it is linked with, over others) by pair of blocks.

    `pairs` has clusters `a` and `b`, which may be the same, each pair once.
    """
    sizes = materialize(
        members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    )
    grid = pairs.join(sizes.select(F.col("cluster").alias("a"), F.col("blocks").alias("rows")), "a")
    grid = materialize(grid.join(sizes.select(F.col("cluster").alias("b"), F.col("blocks").alias("columns")), "b"))
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def side(name: str, first: bool) -> DataFrame:
        mine, theirs = ("rows", "columns") if first else ("columns", "rows")
        dealt = members.join(grid.withColumn("cluster", F.col(name)), "cluster").withColumn("mine", place(mine))
        # Of a cluster with itself, a block meets later ones and itself.
        same = F.col("a") == F.col("b")
        low = F.when(same & F.lit(first), F.col("mine")).otherwise(0)
        high = F.when(same & F.lit(not first), F.col("mine") - 1).otherwise(F.col(theirs) - 1)
        other = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
        out = dealt.select("a", "b", "mine", other.alias("other"), "node", "copies", "vec")
        i, j = ("mine", "other") if first else ("other", "mine")
        return out.select(
            "a", "b", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(first).alias("first"), "node", "copies", "vec"
        )

    keys = ["a", "b", "i", "j"]
    dealt = side("a", True).unionByName(side("b", False)).repartition(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            itself = current[0] == current[1] and current[2] == current[3]
            left = [r for r in held if r[0]]
            right = left if itself else [r for r in held if not r[0]]
            found: list[tuple[int, int, int]] = []
            sizes = {len(r[3]) for r in left} & {len(r[3]) for r in right}
            for size in sizes:
                rows, columns = ([r for r in part if len(r[3]) == size] for part in (left, right))
                units = _units([r[3] for r in rows])
                hit = _linked(units, units if itself else _units([r[3] for r in columns]), min_cosine)
                if itself:
                    np.fill_diagonal(hit, False)
                nodes = [np.array([r[1] for r in part], np.int64) for part in (rows, columns)]
                copies = [np.array([r[2] for r in part], np.int64) for part in (rows, columns)]
                # Ranks of nodes serve as labels.
                known, labels = np.unique(np.concatenate(nodes), return_inverse=True)
                roots = _least_reachable(hit, labels[: len(rows)], labels[len(rows) :])
                counts = hit @ copies[1], copies[0] @ hit
                for part in range(1 if itself else 2):
                    some = np.flatnonzero(hit.any(axis=1 - part))
                    found += zip(nodes[part][some].tolist(), counts[part][some].tolist(), known[roots[part][some]].tolist(), strict=True)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "others", "root"])

        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c).to_pylist() for c in (*keys, "first", "node", "copies")]
                for a, b, i, j, first, node, copies, vector in zip(*columns, _vectors(part), strict=True):
                    if (a, b, i, j) != current:
                        if held:
                            yield done()
                        current, held = (a, b, i, j), []
                    held.append((first, node, copies, vector))
        if held:
            yield done()

    return dealt.mapInArrow(work, "node bigint, others bigint, root bigint")


def _clusters(classes: DataFrame, min_cosine: float) -> DataFrame:
    """`node` and `cluster`: the smallest vector filed in one of its cells that it is near to, or itself."""
    filed = materialize(cell_keys(classes, "node", probed=False))
    first = filed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    met = materialize(filed.join(first.select("key", "leader"), "key").filter("node != leader").select("node", "leader").distinct())

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [len(x) == len(y) and float((_units([x]) @ _units([y]).T)[0, 0]) >= min_cosine for x, y in zip(a, b, strict=True)],
            dtype=bool,
        )

    left = classes.select("node", F.col("vec").alias("x"))
    right = classes.select(F.col("node").alias("leader"), F.col("vec").alias("y"))
    near = met.join(left, "node").join(right, "leader").filter(close("x", "y")).groupBy("node").agg(F.min("leader").alias("leader"))
    return classes.select("node").join(near, "node", "left").select("node", F.coalesce("leader", "node").alias("cluster"))


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """One row per row of `vectors`: the id, `n_links`, `component_id` and `kept`.

    Vectors are compared only when their labels are equal and not null and they have the same
    number of components. `n_links` counts the other vectors found with a cosine of at least
    `min_cosine`; `component_id` is the smallest id reachable over links and `kept` tells whether
    it is the row's own. Equal vectors of a label are one class: they are counted, not expanded
    into pairs. Vectors that are null, empty, zero or hold null or non-finite components have
    no link, and so have rows with a null label; rows without id are left in, with a null
    component and no link. Repeated rows of one id count as one vector if they are equal; different
    vectors of one id are each a vector. Other columns are left out, so their names do not matter.
    """
    ship(vectors.sparkSession)

    @F.pandas_udf("struct<fits:boolean,same:binary>")
    def examined(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for v in batch:
                fits = usable(v)
                values = np.asarray(v, np.float64) + 0.0 if fits else None  # no negative zeros
                rows.append((fits, xxh3_128_digest(values.tobytes()) if fits else None))
            yield pd.DataFrame(rows, columns=["fits", "same"])

    # An array with null components reaches Python as objects, so nulls can be told from NaN.
    found = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vec"), examined(F.col(vector)).alias("h"))
    linkable = F.col("h.fits") & F.col("id").isNotNull() & F.col("label").isNotNull()
    known = materialize(found.select("id", "label", F.coalesce(linkable, F.lit(False)).alias("fits"), "h.same"))
    named = known.filter("fits")
    sizes = materialize(
        named.select("label", "same", "id").distinct().groupBy("label", "same").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
        )
    )
    # One row per class with its vector; equal vectors are combined before the shuffle.
    whole = found.filter(linkable).groupBy("label", "h.same").agg(F.first("vec").alias("vec"))
    classes = materialize(
        whole.join(sizes, ["label", "same"]).select(
            "id", "copies", "label", "same", "vec",
            F.xxhash64("label", "same").alias("node"), F.xxhash64(F.lit("label"), "label").alias("seed"),
        )
    )
    members = materialize(classes.select("node", "copies", "seed", "vec").join(_clusters(classes, min_cosine), "node"))
    filed = materialize(cell_keys(members, "cluster", probed=False).distinct())
    # Where clusters meet: in a cell that both are filed in, or that one is filed in and the other probes.
    other = filed.select("key", F.col("cluster").alias("other"))
    asked = cell_keys(members, "cluster", probed=True).distinct().unionByName(filed)
    met = asked.join(other, "key").filter("cluster != other").select(
        F.least("cluster", "other").alias("a"), F.greatest("cluster", "other").alias("b")
    )
    several = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = materialize(met.distinct().unionByName(several.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"))))
    compared = materialize(_compared(members, pairs, min_cosine))
    linked = compared.groupBy("node").agg(F.sum("others").alias("others"))
    by_node = classes.select("node", "id")
    ties = compared.filter("node != root").select("node", "root").distinct()
    links = ties.join(by_node, "node").select(F.col("id").alias("a"), "root").join(
        by_node.select(F.col("node").alias("root"), F.col("id").alias("b")), "root"
    )
    components = connected_components(materialize(links.select("a", "b")))
    by_class = materialize(
        classes.select("label", "same", "id", "copies", "node").join(linked, "node", "left").join(components, "id", "left")
        .select(
            "label", "same",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    joined = lookup_join(named.select("id", "label", "same"), by_class, ["label", "same"]).select("id", "n_links", "component_id")
    alone = known.filter("NOT fits").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return joined.unionByName(alone).select(F.col("id").alias(id), "n_links", "component_id", kept.alias("kept"))
