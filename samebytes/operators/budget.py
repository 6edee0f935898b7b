"""When each read may start if all readers of a bucket share one rate limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.functions.numbers import io_budget_ms
from samebytes.operators.running import running_charge
from samebytes.operators.scale import ordered_slices


def io_schedule(
    requests: DataFrame,
    mib_per_second: int,
    *,
    order: Sequence[str],
    state: DataFrame | None = None,
) -> DataFrame:
    """Start, delay and end per request (bucket_key, now_ms, bytes, order columns).

    A request starts when it arrives or when the one before it is done, so the end of the i-th
    is `total_i + max(arrival_j - total_before_j)` over all j up to i, with `total` the running
    sum of budgets. Both parts combine across slices: rows are shuffled once, summed up as they lie
    sorted, and the last row of each slice gives the next one its starting point. One bucket for
    everything is therefore no problem. `state` (bucket_key, next_available_at_ms) carries on from earlier.
    """
    budget = io_budget_ms("bytes", mib_per_second)
    charged = requests.withColumn("budget_ms", budget)
    queued = charged.filter(F.col("budget_ms") > 0).withColumn("_asked", F.lit(True))
    if state is not None:
        # What a bucket has left from earlier is a request without cost ahead of all others.
        fields = {"now_ms": F.col("next_available_at_ms"), "bucket_key": F.col("bucket_key"),
                  "budget_ms": F.lit(0), "_asked": F.lit(False)}
        queued = queued.unionByName(state.select(
            *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in queued.schema]
        ))
    sliced = ordered_slices(
        queued, ["bucket_key", "_asked", *order],
        (running_charge("bucket_key", "now_ms", "budget_ms", "_total", "_slack"), "_total bigint, _slack bigint"),
    )
    entries = F.broadcast(_entries(sliced))
    mine = (F.col("_slice") == F.col("_at")) & F.col("bucket_key").eqNullSafe(F.col("_bucket"))
    scheduled = sliced.join(entries, mine, "left").filter("_asked")
    base = F.coalesce("_base", F.lit(0).cast("bigint"))
    floor = F.greatest(F.coalesce("_seen", F.lit(0)), F.lit(0).cast("bigint"))
    end = base + F.col("_total") + F.greatest(floor, F.col("_slack") - base)
    scheduled = scheduled.withColumn("end_ms", end)
    start = F.col("end_ms") - F.col("budget_ms")
    scheduled = scheduled.select(
        *charged.columns,
        start.alias("start_ms"),
        F.greatest(start - F.col("now_ms"), F.lit(0)).alias("delay_ms"),
        "end_ms",
    )
    free = charged.filter(F.col("budget_ms") == 0).select(
        *charged.columns,
        F.col("now_ms").alias("start_ms"),
        F.lit(0).cast("bigint").alias("delay_ms"),
        F.col("now_ms").alias("end_ms"),
    )
    return scheduled.unionByName(free)


def _entries(sliced: DataFrame) -> DataFrame:
    """For each slice that begins within a bucket, what the slices before it leave to that bucket.

    The last row of a slice sums up its last bucket, and only that one can go on: one row per slice.
    """
    ends = sliced.groupBy("_slice").agg(
        F.min_by(F.struct("bucket_key"), "_pos").alias("first"),
        F.max_by(F.struct("bucket_key", "_total", "_slack"), "_pos").alias("last"),
    )
    entries, bucket, base, seen = [], None, 0, 0
    for row in ends.orderBy("_slice").collect():
        goes_on = bool(entries) and row.first.bucket_key == bucket
        entries.append((row["_slice"], row.first.bucket_key, *((base, seen) if goes_on else (0, 0))))
        bucket, total, slack = row.last
        if goes_on and row.first.bucket_key == bucket:
            base, seen = base + total, max(seen, slack - base)
        else:
            base, seen = total, slack
    kind = sliced.schema["bucket_key"].dataType.simpleString()
    return sliced.sparkSession.createDataFrame(entries, f"_at int, _bucket {kind}, _base bigint, _seen bigint")


def io_state(schedule: DataFrame) -> DataFrame:
    """The next free time per bucket after a schedule, to be carried on."""
    used = schedule.filter(F.col("budget_ms") > 0)
    return used.groupBy("bucket_key").agg(F.max("end_ms").alias("next_available_at_ms"))
