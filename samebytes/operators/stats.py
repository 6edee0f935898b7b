"""Summaries of scans and of request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.functions.paths import library_name
from samebytes.operators.hashing import saturated_sum
from samebytes.operators.running import running_sum
from samebytes.operators.scale import ordered_slices, slice_prefix
from samebytes.schemas import LIBRARIES_ROOT

ERROR_SAMPLES = 20


def scan_summary(entries: DataFrame) -> DataFrame:
    """A3: per library and, with `library` NULL, in total, from the entries of a walk."""
    kind = F.col("kind")
    # Libraries are summed up first, so that only their totals are rolled up.
    libraries = entries.groupBy("library").agg(
        F.count_if(kind == "file").alias("files_seen"),
        F.count_if(kind == "directory").alias("directories_seen"),
        saturated_sum(F.when(kind == "file", F.col("size_bytes"))).alias("bytes_seen"),
        F.count_if(kind == "error").alias("error_count"),
    )
    counts = ("files_seen", "directories_seen", "error_count")
    sums = libraries.rollup("library").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        saturated_sum(F.col("bytes_seen")).alias("bytes_seen"),
    )
    status = F.when(F.col("error_count") == 0, "succeeded").otherwise("failed")
    return sums.withColumn("status", status)


def error_digest(
    entries: DataFrame, samples: int = ERROR_SAMPLES, libraries_root: str = LIBRARIES_ROOT
) -> DataFrame:
    """One row with the number of errors and a message made of the first samples.

    Only the first `samples` rows by (library, path) are gathered; the count covers all. Paths
    are shown below the logical root.
    """
    errors = entries.filter(F.col("kind") == "error")
    below = F.nullif("relative_path", F.lit(""))
    path = F.concat_ws("/", F.lit(libraries_root), "library", below)
    text = F.concat_ws(": ", path, "error")
    # The message carries a fixed number of samples by definition.
    first = errors.orderBy("library", "relative_path", "error").limit(samples)
    picked = first.agg(
        F.array_sort(F.collect_list(F.struct("library", "relative_path", "error", text.alias("text"))))
        .alias("rows")
    )
    joined = picked.select(F.array_join(F.col("rows.text"), " | ").alias("text")).scalar()
    counted = errors.agg(F.count(F.lit(1)).alias("error_count")).withColumn("_text", joined)
    # fixed values: wording of the stored message
    message = F.concat(
        F.lit("Scan encountered "), F.col("error_count"), F.lit(" filesystem access errors")
    )
    with_samples = F.when(F.col("_text") != "", F.concat(message, F.lit(": "), F.col("_text")))
    return counted.select("error_count", F.coalesce(with_samples, message).alias("error_message"))


def nearest_rank(df: DataFrame, value: str, ratios: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles as one row; the index is rounded half to even.

    Equal values are counted before they are sorted, then range slices turn the counts into
    positions, so neither a hot value nor a long tail ends up in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    local = ordered_slices(counts, [value], (running_sum("_n", "_upto"), "_upto bigint"))
    sums = local.groupBy("_slice").agg(F.max("_upto").alias("_sum"))
    base = sums.select(
        "_slice", F.coalesce(F.sum("_sum").over(slice_prefix(sums)), F.lit(0)).alias("_base")
    )
    total = sums.agg(F.coalesce(F.sum("_sum"), F.lit(0)).alias("n")).scalar()
    # One row per slice.
    placed = local.join(F.broadcast(base), "_slice").withColumn(
        "_upto", F.col("_base") + F.col("_upto")
    )
    return placed.agg(
        *[
            F.coalesce(
                F.min(F.when(F.col("_upto") > F.bround((total - 1) * F.lit(ratio)), F.col(value))),
                F.lit(0.0),
            ).alias(name)
            for name, ratio in ratios.items()
        ]
    )


def request_statistics(log: DataFrame, elapsed_seconds: float | Column) -> DataFrame:
    """A10: one row about a request log (status, thumb_key, latency_ms)."""
    elapsed = F.lit(elapsed_seconds) if isinstance(elapsed_seconds, float) else elapsed_seconds
    status = F.col("status")
    accepted = status == "accepted"
    counts = log.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(status == "queue_full").alias("queue_full"),
        F.count_if(status == "failed").alias("failed"),
        F.count_distinct(F.when(accepted, F.col("thumb_key"))).alias("unique_thumb_keys"),
    )
    ranks = nearest_rank(log, "latency_ms", {"p50": 0.50, "p95": 0.95})
    pair = ranks.select(F.struct("p50", "p95").alias("r")).scalar()
    requests = F.col("requests")

    def ratio(part: Column) -> Column:
        return F.when(requests > 0, part / requests).otherwise(F.lit(0.0))

    return counts.withColumn("_ranks", pair).select(
        *counts.columns,
        F.when(elapsed > 0, requests / elapsed).otherwise(F.lit(0.0)).alias("throughput_rps"),
        ratio(F.col("queue_full")).alias("queue_full_ratio"),
        ratio(F.col("failed")).alias("failed_ratio"),
        F.when(F.col("accepted") > 0, 1 - F.col("unique_thumb_keys") / F.col("accepted"))
        .otherwise(F.lit(1.0))
        .alias("dedupe_ratio"),
        F.col("_ranks.p50").alias("latency_p50_ms"),
        F.col("_ranks.p95").alias("latency_p95_ms"),
    )


def threshold_failures(
    stats: DataFrame,
    at_least: dict[str, float] | None = None,
    at_most: dict[str, float] | None = None,
) -> DataFrame:
    """Metrics outside their limits as (metric, value, limit)."""
    checks = [(name, limit, "min") for name, limit in (at_least or {}).items()]
    checks += [(name, limit, "max") for name, limit in (at_most or {}).items()]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(limit)).alias("limit"),
                F.lit(side).alias("side"),
            )
            for name, limit, side in checks
        ]
    )
    broken = F.when(F.col("side") == "min", F.col("value") < F.col("limit")).otherwise(
        F.col("value") > F.col("limit")
    )
    return stats.select(F.inline(rows)).filter(broken)


def top_errors(log: DataFrame, column: str = "error", limit: int = 5) -> DataFrame:
    """Most frequent error texts, ties by text."""
    counted = log.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    return counted.orderBy(F.desc("occurrences"), column).limit(limit)


def scan_targets(names: DataFrame, column: str = "name") -> DataFrame:
    """Valid library names, once each, in order."""
    parsed = names.select(library_name(column).alias("n"))
    return parsed.filter("n.ok").select(F.col("n.name").alias("name")).distinct().orderBy("name")
