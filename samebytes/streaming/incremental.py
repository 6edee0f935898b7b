"""The batch operators, run continuously with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samebytes.functions.hashes import group_key
from samebytes.functions.predicates import Clock, dedup_eligible
from samebytes.operators.merge import KEY, SEEN, assign_ids, merge_scan
from samebytes.operators.scale import lookup_join, materialize
from samebytes.plans.catalog import refresh_totals
from samebytes.schemas import LEASE_TTL_SECONDS, LIBRARY_FILES
from samebytes.sources.filetree import changed_files
from samebytes.sources.store import SnapshotStore


SESSION_SETTINGS = {
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def merge_stream(
    scans: DataFrame, store: SnapshotStore, checkpoint: str, *, scan_id: int, now: Clock
) -> StreamingQuery:
    """Every micro-batch of scanned files becomes a new catalog version.

    A file seen twice in a batch counts once, with its newest modification time. Missing
    files are left to a complete scan, since no batch is one. A batch reads and writes the
    buckets of the catalog that its files fall into, and no others.

    A batch that is replayed after a crash is found in `merged_batches` and skipped. Batch
    numbers belong to a checkpoint: a stream with a new one merges everything it reads.
    """
    log = "stream string, batch long"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = store.current_version("merged_batches") > 0
        merged = store.read("merged_batches") if known else spark.createDataFrame([], log)
        mine = F.col("stream") == checkpoint
        if not merged.filter(mine & (F.col("batch") >= batch_id)).isEmpty():
            return
        newest = batch.groupBy(*KEY).agg(
            F.max_by(F.struct(*SEEN), F.struct("mtime_ns", "size_bytes")).alias("s")
        )
        scan = materialize(newest.select(*KEY, "s.*"))
        touched = store.touched("library_files", scan)
        catalog = store.read("library_files", buckets=touched)
        nothing = scan.select("library_id").limit(0)
        after = merge_scan(
            catalog, scan, nothing, scan_id=scan_id, now=now, complete=False,
            new_ids=assign_ids(catalog, scan, largest=store.top_id("library_files")),
        )
        # A crash between the two writes repeats the merge, which then changes nothing more.
        store.replace("library_files", after.drop("change"), touched)
        done = spark.createDataFrame([(checkpoint, batch_id)], log)
        store.publish("merged_batches", merged.filter(~mine).unionByName(done).coalesce(1))

    return (
        scans.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watch_libraries(
    store: SnapshotStore, libraries_root: str, checkpoint: str, *, scan_id: int, now: Clock,
    lag_seconds: float = 2.0,
) -> StreamingQuery:
    """X1 from disk: files that changed under the libraries of a root since the last batch reach the catalog.

    Libraries have to be registered in `library_roots`; files of others are left out. Files that went
    stay until a complete scan.
    """
    spark = store.spark
    known = store.read("library_roots").select(F.col("name").alias("library"), F.col("id").alias("library_id"))
    files = changed_files(spark, libraries_root, lag_seconds).join(F.broadcast(known), "library")
    return merge_stream(files.select(*KEY, *SEEN), store, checkpoint, scan_id=scan_id, now=now)


def distinct_requests(
    requests: DataFrame, key: str = "thumb_key", time: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """The first request per variant. With a time column, state older than `delay` is
    dropped; without one, keys are kept for good."""
    if time is None:
        return requests.dropDuplicates([key])
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def silent_workers(
    heartbeats: DataFrame,
    *,
    ttl_seconds: int = LEASE_TTL_SECONDS,
    delay: str = "10 minutes",
    clock: DataFrame | None = None,
) -> DataFrame:
    """Spans (worker, ts) of a worker that ended in silence of at least the lease time.

    A stream reports a session once the watermark has passed its last heartbeat by the lease
    time; over a table all sessions come out, the last one of each worker included. Heartbeats
    alone move the watermark only as long as some worker is alive; `clock` (ts) is a stream
    of times that moves it as well, such as the `rate` source, so that the last spans end too. It
    belongs to no worker and reports nothing.
    `SESSION_SETTINGS` merge heartbeats before they are shuffled, so that a worker with most
    of them arrives as a few sessions.
    """
    watched = heartbeats
    if clock is not None:
        ticks = clock.select(F.lit(None).cast(heartbeats.schema["worker"].dataType).alias("worker"), "ts")
        watched = heartbeats.select("worker", "ts", F.lit(True).alias("alive")).unionByName(
            ticks.withColumn("alive", F.lit(False))
        )
    if heartbeats.isStreaming:
        watched = watched.withWatermark("ts", delay)
    if clock is not None:
        # The condition reads the event time, so that it stays behind the watermark.
        watched = watched.filter(F.when(F.col("ts").isNotNull(), F.col("alive")))
    session = F.session_window("ts", f"{ttl_seconds} seconds")
    return (
        watched.groupBy("worker", session.alias("span"))
        .agg(F.count(F.lit(1)).alias("heartbeats"))
        .select(
            "worker",
            F.col("span.start").alias("first_heartbeat"),
            F.col("span.end").alias("stale_at"),
            "heartbeats",
        )
    )


def running_groups(files: DataFrame) -> DataFrame:
    """Group totals as hashed rows arrive (append-only input, complete or update mode).

    A group shows up when its second file arrives. State grows with the number of contents.
    """
    totals = (
        files.filter(dedup_eligible())
        .groupBy("hash_algorithm", "content_hash")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("size_bytes").alias("total_size_bytes"),
            (F.sum("size_bytes") - F.min("size_bytes")).alias("duplicate_waste_bytes"),
            F.min("id").alias("sample_file_id"),
        )
        .filter(F.col("file_count") > 1)
    )
    key = group_key("hash_algorithm", "content_hash").alias("group_key")
    return totals.select(key, *totals.columns[2:])


def group_stream(files: DataFrame, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """X4 with retractions: catalog rows as they change, and the totals of their contents after each batch.

    `files` has whole catalog rows; the last one of a file (by `updated_at`, then `id`) in a batch
    replaces the one before. Nothing is kept in the state of the query: the catalog and the totals are
    tables, of which a batch writes the buckets that it touches. A batch that is run again changes
    nothing more. `groups_of_totals` makes groups of the totals.
    """
    names = LIBRARY_FILES.fieldNames()

    def merge(batch: DataFrame, batch_id: int) -> None:
        order = F.struct("updated_at", "id")
        newest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*names), order).alias("f")).select("f.*")
        rows = materialize(newest)
        touched = store.touched("library_files", rows)
        part = store.read("library_files", buckets=touched)
        kept = lookup_join(part, rows.select(*KEY), KEY, "left_anti")
        store.replace("library_files", kept.select(*names).unionByName(rows.select(*names)), touched)
        refresh_totals(store)

    return (
        files.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_groups(updates: DataFrame) -> DataFrame:
    """The current state of each group from rows written in update mode; counts only grow."""
    values = F.struct(*[c for c in updates.columns if c != "group_key"])
    newest = updates.groupBy("group_key").agg(F.max_by(values, "file_count").alias("v"))
    return newest.select("group_key", "v.*")
