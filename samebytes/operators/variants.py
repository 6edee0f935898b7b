"""Planning derived variants of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samebytes.functions.common import as_timestamp, is_blank, seconds, strip
from samebytes.functions.hashes import group_key
from samebytes.functions.paths import contained_under, media_type, safe_relative_path
from samebytes.functions.predicates import Clock, due
from samebytes.functions.variants import (
    output_path,
    thumb_key,
    variant_dimension,
    variant_format,
)
from samebytes.operators.scale import (
    TOP_K_ROWS,
    batch_join,
    first_rows,
    lookup_join,
    materialize,
    rows_not_in,
    with_position,
)
from samebytes.schemas import (
    CLEANUP_DELAY_SECONDS,
    CLEANUP_JOBS,
    LIBRARIES_ROOT,
    THUMBNAILS,
    VARIANT_CAPACITY,
    VARIANT_CONCURRENCY,
    VARIANT_MAX_DIMENSION,
    VARIANT_VERSION,
)

ACTIVE = ("pending", "running")
TERMINAL = ("ready", "failed")


def plan_requests(
    requests: DataFrame,
    files: DataFrame,
    roots: DataFrame,
    *,
    libraries_root: str = LIBRARIES_ROOT,
    max_dimension: int = VARIANT_MAX_DIMENSION,
) -> DataFrame:
    """J8 with F9-F12: one row per distinct request, with its variant or its `reject` reason.

    `requests` has seq, file_id, max_dimension and output_format. Equal requests are
    collapsed before any join, so a file that everybody asks for is one row afterwards;
    `first_seq` and `requests` keep the order and the volume. A batch that is small against the
    catalog looks up its files there, and the catalog stays where it is.
    """
    wanted = requests.select(
        "seq",
        "file_id",
        variant_dimension("max_dimension", max_dimension).alias("max_dimension"),
        variant_format("output_format").alias("format"),
    )
    distinct = wanted.groupBy("file_id", "max_dimension", "format").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("requests")
    )
    known = files.select(
        F.col("id").alias("file_id"),
        F.lit(True).alias("_file"),
        "library_id",
        "relative_path",
        "is_missing",
        "size_bytes",
        "mtime_ns",
        "hash_algorithm",
        "content_hash",
    )
    paths = roots.select(F.col("id").alias("library_id"), "root_path")
    found = batch_join(materialize(distinct), known, ["file_id"])
    joined = lookup_join(found, paths, "library_id", "left")
    full_path = F.concat_ws("/", "root_path", "relative_path")
    kind = media_type("relative_path")
    reject = (
        F.when(F.col("format").isNull(), "unsupported_format")
        .when(F.col("max_dimension").isNull(), "bad_dimension")
        .when(F.col("_file").isNull(), "file_not_found")
        .when(F.col("is_missing"), "file_missing")
        .when(F.col("root_path").isNull(), "root_missing")
        .when(~contained_under(F.lit(libraries_root), "root_path"), "root_outside_libraries")
        .when(~safe_relative_path("relative_path")["ok"], "unsafe_path")
        .when(~contained_under("root_path", full_path), "unsafe_path")
        .when(kind.isNull(), "unsupported_media")
    )
    key = thumb_key(
        "file_id", "hash_algorithm", "content_hash", "size_bytes", "mtime_ns",
        "max_dimension", "format",
    )
    planned = joined.withColumn("reject", reject).withColumn(
        "thumb_key", F.when(F.col("reject").isNull(), key)
    )
    return planned.select(
        "first_seq",
        "requests",
        "file_id",
        "max_dimension",
        "format",
        "reject",
        "thumb_key",
        F.when(F.col("reject").isNull(), kind).alias("media_type"),
        group_key("hash_algorithm", "content_hash").alias("group_key"),
        F.col("size_bytes").alias("source_size_bytes"),
        F.col("mtime_ns").alias("source_mtime_ns"),
        output_path("thumb_key", "format").alias("output_relpath"),
    )


def match_variants(planned: DataFrame, variants: DataFrame, now: Clock) -> DataFrame:
    """`outcome` existing, requeued, blocked or new for every accepted plan row.

    Variants are not shuffled for a batch that is small.
    """
    current = variants.select(
        "thumb_key", F.col("status").alias("_status"), F.col("retry_after").alias("_retry")
    )
    outcome = (
        F.when(F.col("_status").isNull(), "new")
        .when(F.col("_status") != "failed", "existing")
        .when(due("_retry", now), "requeued")
        .otherwise("blocked")
    )
    accepted = materialize(planned.filter(F.col("reject").isNull()))
    return batch_join(accepted, current, ["thumb_key"]).withColumn("outcome", outcome).drop("_status", "_retry")


def active_depth(variants: DataFrame) -> DataFrame:
    """How many variants wait or run."""
    return variants.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def admit(
    matched: DataFrame, variants: DataFrame, capacity: int = VARIANT_CAPACITY
) -> DataFrame:
    """New variants become `admitted` while slots are free, then `queue_full`.

    Requeued variants take a slot without being checked. Nothing leaves the queue within a
    batch, so the free slots go to the first rows by `first_seq`, and the last of these is all
    that the other rows are compared with. A small capacity orders no more rows than it has.
    The rows are needed twice, so they are written once.
    """
    matched = materialize(matched)
    active = active_depth(variants).scalar()
    order = ["first_seq", "thumb_key"]
    takers = matched.filter(F.col("outcome").isin("new", "requeued")).select(*order)
    if capacity <= TOP_K_ROWS:
        first = first_rows(takers, order, capacity)
        rank = F.row_number().over(Window.orderBy(*order))
        placed = first.withColumn("_place", rank - 1)
    else:
        placed = with_position(takers, order, "_place")
    last = placed.filter(F.col("_place") + active < capacity).agg(F.max(F.struct(*order)))
    final = F.when(
        F.col("outcome") == "new",
        F.when(F.struct(*order) <= last.scalar(), "admitted").otherwise("queue_full"),
    ).otherwise(F.col("outcome"))
    return matched.withColumn("outcome", final)


def apply_requests(
    variants: DataFrame, admitted: DataFrame, now: Clock, largest: int | None = None
) -> DataFrame:
    """The variant table after a batch: requeued rows reset, admitted rows added (W8 ids).

    `largest` is the largest id where `variants` is a part of the table.
    """
    stamp = as_timestamp(now)
    again = admitted.filter(F.col("outcome") == "requeued").select(
        "thumb_key", F.lit(True).alias("_again")
    )
    cleared = (
        "error_code", "error_message", "retry_after", "worker_id", "worker_heartbeat_at",
        "lease_expires_at", "started_at", "finished_at",
    )
    kept = lookup_join(variants, again, "thumb_key", "left")
    for name in cleared:
        kept = kept.withColumn(name, F.when(F.col("_again").isNull(), F.col(name)))
    kept = kept.withColumn(
        "status", F.when(F.col("_again"), "pending").otherwise(F.col("status"))
    ).withColumn("updated_at", F.when(F.col("_again"), stamp).otherwise(F.col("updated_at")))

    new = with_position(
        admitted.filter(F.col("outcome") == "admitted"), ["first_seq", "thumb_key"], "_rank"
    )
    top = F.lit(largest) if largest is not None else variants.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    fixed = {
        "id": top + F.col("_rank") + 1,
        "status": F.lit("pending"),
        "version": F.lit(VARIANT_VERSION),
        "error_count": F.lit(0),
        "created_at": stamp,
        "updated_at": stamp,
    }
    inserted = new.select(
        *[
            fixed.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in THUMBNAILS
        ]
    )
    return kept.select(*THUMBNAILS.fieldNames()).unionByName(inserted)


def task_details(variants: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything a worker needs for a variant."""
    sources = files.select(F.col("id").alias("file_id"), "library_id", "relative_path")
    paths = roots.select(F.col("id").alias("library_id"), "root_path")
    return lookup_join(variants.join(sources, "file_id"), paths, "library_id").select(
        "id", "thumb_key", "file_id", "relative_path", "root_path", "media_type", "format",
        "max_dimension", "source_size_bytes", "source_mtime_ns",
        F.coalesce("output_relpath", F.lit("")).alias("output_relpath"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
    )


def live_running(variants: DataFrame, now: Clock) -> DataFrame:
    """Running variants with a live lease, per media type."""
    live = (F.col("status") == "running") & (F.col("lease_expires_at") > as_timestamp(now))
    return variants.groupBy("media_type").agg(F.count_if(live).alias("running"))


def next_variants(
    variants: DataFrame, now: Clock, concurrency: dict[str, int] | None = None
) -> DataFrame:
    """Per media type, the oldest due variants that the free workers can take.

    Each media type of `concurrency` is a top-k of its own, whatever its limit, so no task gets all
    waiting variants of a type. The number of running variants is counted first, and variants are read
    once for that and once per media type, of which there are two.
    """
    limits = VARIANT_CONCURRENCY if concurrency is None else concurrency
    waiting = variants.filter((F.col("status") == "pending") & due("retry_after", now))
    busy = live_running(variants, now).filter(F.col("media_type").isin(*limits))
    # One row per media type of the limits.
    running = {row.media_type: row.running for row in busy.collect()}
    first = [
        first_rows(waiting.filter(F.col("media_type") == kind), ["created_at", "id"], max(0, limit - running.get(kind, 0)))
        for kind, limit in limits.items()
    ]
    return reduce(DataFrame.unionByName, first) if first else waiting.limit(0)


def ready_cleanups(cleanups: DataFrame, variants: DataFrame, now: Clock) -> DataFrame:
    """Due cleanups of groups that have no variant waiting or running."""
    waiting = (F.col("status") == "pending") & (F.col("execute_after") <= as_timestamp(now))
    busy = (
        variants.filter(F.col("status").isin(*ACTIVE) & F.col("group_key").isNotNull())
        .select("group_key")
        .distinct()
    )
    return cleanups.filter(waiting).join(busy, "group_key", "left_anti")


def schedule_cleanups(
    cleanups: DataFrame,
    requests: DataFrame,
    now: Clock,
    default_delay: int = CLEANUP_DELAY_SECONDS,
) -> DataFrame:
    """One cleanup per group after a batch of requests (seq, group_key, delay_seconds).

    The last valid request of a group counts; blank keys and negative delays are left out.
    """
    stamp = as_timestamp(now)
    valid = requests.withColumn("group_key", strip("group_key")).filter(
        ~is_blank("group_key") & (F.coalesce("delay_seconds", F.lit(0)) >= 0)
    )
    last = valid.groupBy("group_key").agg(
        F.max_by(F.coalesce("delay_seconds", F.lit(default_delay)), "seq").alias("_delay")
    )
    asked = materialize(last.select("group_key", (stamp + seconds(F.col("_delay"))).alias("_due")))
    hit = F.col("_due").isNotNull()
    cleared = (
        "worker_id", "worker_heartbeat_at", "lease_expires_at", "error_code", "error_message",
        "finished_at",
    )
    kept = lookup_join(cleanups, asked, "group_key", "left")
    for name in cleared:
        kept = kept.withColumn(name, F.when(~hit, F.col(name)))
    kept = (
        kept.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))
        .withColumn("execute_after", F.coalesce("_due", "execute_after"))
        .withColumn("updated_at", F.when(hit, stamp).otherwise(F.col("updated_at")))
    )
    new = with_position(
        rows_not_in(asked, cleanups, ["group_key"]), ["group_key"], "_rank"
    )
    largest = cleanups.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    fixed = {
        "id": largest + F.col("_rank") + 1,
        "group_key": F.col("group_key"),
        "status": F.lit("pending"),
        "execute_after": F.col("_due"),
        "created_at": stamp,
        "updated_at": stamp,
    }
    inserted = new.select(
        *[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CLEANUP_JOBS]
    )
    return kept.select(*CLEANUP_JOBS.fieldNames()).unionByName(inserted)


def prunable_variants(variants: DataFrame, groups: DataFrame) -> DataFrame:
    """Finished variants of the given groups, with the output to remove.

    `removable` is false where there is no output or its path is not safe to follow.
    """
    keys = groups.select(strip("group_key").alias("group_key")).distinct()
    done = variants.filter(F.col("status").isin(*TERMINAL))
    return lookup_join(done, keys, "group_key", "left_semi").select(
        "id",
        "group_key",
        F.coalesce("output_relpath", F.lit("")).alias("output_relpath"),
        (~is_blank("output_relpath") & safe_relative_path("output_relpath")["ok"]).alias(
            "removable"
        ),
    )


def prune_variants(variants: DataFrame, groups: DataFrame) -> DataFrame:
    """The variant table without them; waiting and running rows stay."""
    hit = F.lit(True).alias("_hit")
    keys = groups.select(strip("group_key").alias("group_key"), hit).distinct()
    joined = lookup_join(variants, keys, "group_key", "left")
    gone = F.col("_hit").isNotNull() & F.col("status").isin(*TERMINAL)
    return joined.filter(~gone).select(*variants.columns)


def drop_orphans(
    roots: DataFrame, files: DataFrame, variants: DataFrame, sessions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Files of known roots (unknown scan references nulled) and variants of those files."""
    libraries = roots.select(F.col("id").alias("library_id"))
    kept = lookup_join(files, libraries, "library_id", "left_semi")
    scans = sessions.select(F.col("id").alias("last_seen_scan_id"), F.lit(True).alias("_scan"))
    kept = lookup_join(kept, scans, "last_seen_scan_id", "left")
    kept = kept.withColumn(
        "last_seen_scan_id", F.when(F.col("_scan"), F.col("last_seen_scan_id"))
    ).select(*files.columns)
    owners = kept.select(F.col("id").alias("file_id"))
    return kept, variants.join(owners, "file_id", "left_semi")


def variant_metrics(variants: DataFrame, cleanups: DataFrame, now: Clock) -> DataFrame:
    """A5: both queues in one row from one pass over each table."""
    nothing = F.lit(None).cast("timestamp")
    rows = variants.select(
        F.lit(True).alias("variant"), "status", "retry_after", nothing.alias("execute_after")
    ).unionByName(
        cleanups.select(
            F.lit(False).alias("variant"), "status", nothing.alias("retry_after"), "execute_after"
        )
    )
    clock = as_timestamp(now)

    def state(variant: bool, status: str) -> Column:
        return (F.col("variant") == variant) & (F.col("status") == status)

    failed = state(True, "failed")
    waiting = failed & F.coalesce(F.col("retry_after") > clock, F.lit(False))
    overdue = state(False, "pending") & (F.col("execute_after") <= clock)
    oldest = F.min(F.when(overdue, F.col("execute_after")))
    lag = F.call_function("div", F.unix_micros(clock) - F.unix_micros(oldest), F.lit(1_000_000))
    return rows.agg(
        F.count_if(state(True, "pending") | state(True, "running")).alias("queue_depth"),
        F.count_if(state(True, "pending")).alias("queue_pending"),
        F.count_if(state(True, "running")).alias("queue_running"),
        F.count_if(waiting).alias("retry_backlog"),
        F.count_if(failed & ~waiting).alias("retry_ready"),
        F.count_if(state(False, "pending")).alias("cleanup_pending"),
        F.count_if(state(False, "running")).alias("cleanup_running"),
        F.count_if(overdue).alias("cleanup_overdue"),
        F.greatest(F.coalesce(lag, F.lit(0)), F.lit(0)).alias("cleanup_max_lag_seconds"),
    )
