"""Building blocks that keep global order and small-table joins scalable.

* `ordered_slices` range-partitions rows by a total order and freezes the result, so that a
  position, a running sum or a look at the previous row needs only one row per slice from
  the rest of the table. No step puts all rows, or all rows of one key, into one task.
* `lookup_join` broadcasts only a side whose rows and bytes were measured.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samebytes.operators.running import Pass, previous_rows
from samebytes.sources import ship

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
TOP_K_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is made for local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="samebytes-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to the checkpoint folder and go on from there.

    Needed wherever rows are used twice and must be the same both times, and it survives
    the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is small, by its real rows and bytes, measured in one aggregation.

    The size of arrays, maps and structs is not known, so tables with such columns never fit.
    """
    text = F.lit(0).cast("bigint")
    for field in df.schema:
        if field.dataType.typeName() in ("array", "map", "struct", "variant"):
            return False
        if field.dataType.typeName() in ("string", "binary"):
            text = text + F.coalesce(F.octet_length(field.name), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return rows <= max_rows and size + 16 * rows * len(df.columns) <= BROADCAST_BYTES


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str] | Column,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a table that is usually small.

    The right side is broadcast only when it is measured to be small. Otherwise this is an
    ordinary shuffle join, where adaptive execution splits skewed keys.
    """
    if fits_broadcast(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)


def rows_asked_for(big: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a big table whose key is among a few, which are sent to it; it is not shuffled."""
    return big.join(F.broadcast(keys), keys.columns, "left_semi")


def batch_join(
    batch: DataFrame, big: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a batch with a big table that holds a key at most once.

    The keys of a batch measured to be small cut the big table down to the rows they ask for, where
    it lies; the cut, written once and measured in turn, is looked up by the batch. A larger batch is
    an ordinary join. The batch is read twice, so it should be a table already.
    """
    keys = batch.select(*on)
    if not fits_broadcast(keys, max_rows):
        return batch.join(big, on, how)
    return lookup_join(batch, materialize(rows_asked_for(big, keys)), on, how, max_rows)


def rows_not_in(
    rows: DataFrame, table: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose key the table does not have.

    Rows measured to be few are looked up in place, so that a big table is not shuffled for
    them; otherwise it is an ordinary anti join.
    """
    known = table.select(*keys)
    if fits_broadcast(rows.select(*keys), max_rows):
        # No more keys than rows, so the second broadcast is as small as the first.
        wanted = F.broadcast(rows.select(*keys))
        known = F.broadcast(known.join(wanted, keys, "left_semi").distinct())
    return rows.join(known, keys, "left_anti")


def first_rows(df: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first `limit` rows by `order`, which must be unique per row.

    Every task of a top-k sends its k best rows to one task, so beyond `TOP_K_ROWS` positions
    in range slices are used instead. Either way the rows come out in order.
    """
    if limit <= TOP_K_ROWS:
        return df.orderBy(*order).limit(limit)
    return with_position(df, order, "_place").filter(F.col("_place") < limit).drop("_place").orderBy(*order)


def ordered_slices(
    df: DataFrame, order: Sequence[Column | str], running: tuple[Pass, str] | None = None
) -> DataFrame:
    """Rows sorted by `order` in contiguous slices, with `_slice` and 0-based `_pos` in it.

    `order` must be unique per row, so that retries put every row at the same place. `running` is a
    pass over the sorted rows of a slice with the columns (DDL) that it adds; it takes place before
    the rows are frozen, so they are shuffled and written once.
    """
    row = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if running is not None:
        ship(df.sparkSession)
        work, added = running
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        ordered = ordered.mapInArrow(work, f"{kept}, {added}")
    numbered = ordered.withColumn("_row", row).select(
        *ordered.columns,
        F.shiftright("_row", 33).cast("int").alias("_slice"),
        F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    return materialize(numbered)


def slice_prefix(summary: DataFrame, keys: Sequence[str] = ()) -> Window:
    """All slices before the current one; `summary` holds one row per slice (and key)."""
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )


def with_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """0-based global position by `order`, as a global `row_number() - 1` would give."""
    sliced = ordered_slices(df, order)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        "_slice",
        F.coalesce(F.sum("_size").over(slice_prefix(sizes)), F.lit(0)).alias("_offset"),
    )
    # One row per slice, and there are at most as many slices as shuffle partitions.
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_slice", "_pos", "_offset")
    )


def with_previous(
    df: DataFrame, key: str, order: Sequence[Column | str], columns: dict[str, str]
) -> DataFrame:
    """`lag` per key without gathering a key in one task.

    `columns` maps each source column to the name of its value in the previous row of the key.
    """
    slim = {c: f"_before_{c}" for c in columns}
    added = ", ".join(f"`{slim[c]}` {df.schema[c].dataType.simpleString()}" for c in columns)
    sliced = ordered_slices(df, [key, *order], (previous_rows(key, slim), added))
    values = F.struct(F.col(key).alias("_key"), *[F.col(c).alias(c) for c in columns])
    last = sliced.groupBy("_slice").agg(F.max_by(values, "_pos").alias("_last"))
    # One row per slice: the last row of the slice before it.
    edges = last.select(
        "_slice", F.lag("_last").over(Window.orderBy("_slice")).alias("_edge")
    )
    joined = sliced.join(F.broadcast(edges), "_slice")
    # Only the first row of a slice looks back into another one.
    goes_on = (F.col("_pos") == 0) & F.col("_edge").isNotNull() & F.col("_edge._key").eqNullSafe(F.col(key))
    return joined.select(
        *df.columns,
        *[F.when(goes_on, F.col(f"_edge.{c}")).otherwise(F.col(slim[c])).alias(name) for c, name in columns.items()],
    )
