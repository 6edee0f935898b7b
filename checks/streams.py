"""Structured Streaming twins, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog import GROUPS, flat, merged_sql
from checks.registry import check
from checks.views import NOW, Tables
from samebytes.operators import duplicates
from samebytes.operators.scale import shared_folder
from samebytes.plans.catalog import refresh_totals
from samebytes.sources.store import SnapshotStore
from samebytes.streaming import incremental


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


class _Streams(Tables):
    """The same views, fed by a stream over the parquet files."""

    def base(self, name: str):
        # A table is one file or a folder of them. A stream takes both by a pattern, which needs a base path.
        reader = self.spark.readStream.schema(super().base(name).schema).option("basePath", self.folder)
        return reader.parquet(f"{self.folder}/{{{name}.parquet}}")


def _run(query, target: str, checkpoint: str, mode: str = "append"):
    def write(batch, batch_id):
        batch.write.mode("append").parquet(target)

    writer = query.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", target)
    else:
        writer = writer.foreachBatch(write)
    writer.trigger(availableNow=True).start().awaitTermination()
    return query.sparkSession.read.parquet(target)


_DROPS = 3


@check(
    "x1_incremental_catalog",
    f""", joined AS (SELECT f.*, s.library_id AS n_library, s.relative_path AS n_path, s.size_bytes AS n_size, s.mtime_ns AS n_mtime, s.inode AS n_inode, s.device AS n_device,
 CASE WHEN f.id IS NULL THEN 'added' WHEN s.library_id IS NULL THEN 'untouched' WHEN f.is_missing THEN 'reappeared'
  WHEN f.size_bytes <> s.size_bytes OR f.mtime_ns <> s.mtime_ns OR coalesce(f.inode, -1) <> coalesce(s.inode, -1) OR coalesce(f.device, -1) <> coalesce(s.device, -1) THEN 'changed' ELSE 'unchanged' END AS change
 FROM catalog f FULL OUTER JOIN scan s ON s.library_id = f.library_id AND s.relative_path = f.relative_path)
SELECT """
    + merged_sql(f"(SELECT max(id) FROM files) + row_number() OVER (PARTITION BY id IS NULL ORDER BY n_library % {_DROPS}, n_library, n_path)")
    + " FROM joined",
    "files catalog scan",
)
def _(t):
    store = SnapshotStore(t.spark, _folder(t, "store"))
    store.publish("library_files", t.catalog)
    drops, checkpoint = _folder(t, "drops"), _folder(t, "ckpt")
    # The scan arrives in several drops, one after the other, and new files get ids in that order. A drop
    # has a file from each task that writes it; all of them are one batch of the stream, which goes on
    # from its checkpoint when the next drop is there.
    for drop in range(_DROPS):
        t.scan.filter(F.col("library_id") % _DROPS == drop).write.mode("append").parquet(drops)
        scans = t.spark.readStream.schema(t.scan.schema).parquet(drops)
        incremental.merge_stream(scans, store, checkpoint, scan_id=77, now=NOW).awaitTermination()
    return flat(store.read("library_files"))


@check(
    "x2_request_deduplication",
    "SELECT DISTINCT file_id || ':' || max_dimension || ':' || output_format AS thumb_key FROM requests",
    "requests",
)
def _(t):
    # State older than the watermark goes; the whole log lies within one batch and its delay.
    requests = _Streams(t.spark, t.folder).requests
    keyed = requests.withColumn("thumb_key", F.concat_ws(":", "file_id", "max_dimension", "output_format"))
    unique = incremental.distinct_requests(keyed, time="requested_at", delay="1 hour").select("thumb_key")
    return _run(unique, _folder(t, "out"), _folder(t, "ckpt"))


_SILENT = """WITH s AS (SELECT user_id AS worker, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
 n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 300 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts, event_id) AS span FROM s),
 g AS (SELECT worker, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 300000000 AS stale_us, count(*) AS heartbeats FROM n GROUP BY worker, span)
 SELECT * FROM g"""


def _beats(t, clock=None):
    for key, value in incremental.SESSION_SETTINGS.items():
        t.spark.conf.set(key, value)
    beats = t.events.select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    return incremental.silent_workers(beats, clock=clock).select(
        "worker",
        F.unix_micros("first_heartbeat").alias("first_us"),
        F.unix_micros("stale_at").alias("stale_us"),
        "heartbeats",
    )


@check("x3_lease_silence", _SILENT)
def _(t):
    # A clock that has gone on for an hour after the last heartbeat ends all spans.
    ticks = _folder(t, "ticks")
    t.events.agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("ts")).write.parquet(ticks)
    clock = t.spark.readStream.schema("ts timestamp").parquet(ticks)
    return _run(_beats(_Streams(t.spark, t.folder), clock), _folder(t, "out"), _folder(t, "ckpt"))


@check("x3_lease_silence_batch", _SILENT)
def _(t):
    return _beats(t)


@check(
    "x4_running_groups",
    GROUPS + "SELECT group_key, file_count, total_size_bytes, duplicate_waste_bytes, sample_file_id FROM grouped",
    "files",
)
def _(t):
    totals = incremental.running_groups(_Streams(t.spark, t.folder).files)
    return incremental.latest_groups(_run(totals, _folder(t, "out"), _folder(t, "ckpt"), "update"))


@check(
    "x4_group_table",
    GROUPS + "SELECT group_key, file_count, total_size_bytes, duplicate_waste_bytes, sample_file_id FROM grouped",
    "files",
)
def _(t):
    # Files arrive with other contents first, some of them present that go missing later.
    store = SnapshotStore(t.spark, _folder(t, "store"), buckets=8)
    drops, checkpoint = _folder(t, "drops"), _folder(t, "ckpt")
    early = t.catalog.filter("id % 3 > 0").withColumns({
        "is_missing": F.lit(False), "needs_hash": F.lit(False), "hash_algorithm": F.lit("sha256"),
        "content_hash": F.unhex(F.sha2((F.col("id") % 40).cast("string"), 256)),
        "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 DAY"),
    })
    for rows in (early, t.catalog):
        # A file from each task; all files of a drop are one batch, since the next drop is not there yet.
        rows.write.mode("append").parquet(drops)
        stream = t.spark.readStream.schema(t.catalog.schema).parquet(drops)
        incremental.group_stream(stream, store, checkpoint).awaitTermination()
    groups = duplicates.groups_of_totals(refresh_totals(store))
    return groups.select("group_key", "file_count", "total_size_bytes", "duplicate_waste_bytes", "sample_file_id")
