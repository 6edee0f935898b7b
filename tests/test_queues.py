from datetime import datetime

import pytest
from pyspark.sql import functions as F

from samebytes import schemas as S
from samebytes.functions.cursors import InvalidCursor
from samebytes.operators import conform, queues, stats

NOW = "2026-01-10 00:00:00"
NOON = datetime(2026, 1, 10)


def jobs(spark, rows):
    """(id, kind, status, created_at)"""
    df = spark.createDataFrame(rows, "id string, kind string, status string, created_at timestamp")
    return conform.conform(df, "jobs", NOW)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_oldest_running_job_is_kept(spark):
    table = jobs(spark, [("job-a", "SCAN", "RUNNING", datetime(2026, 1, 1)), ("job-b", "HASH", "RUNNING", datetime(2026, 1, 2)), ("job-c", "delete", "running", datetime(2025, 1, 1))])
    after = by_id(queues.keep_one_running(table, NOW))
    assert (after["job-a"].status, after["job-c"].status) == ("RUNNING", "running")
    assert (after["job-b"].status, after["job-b"].error_code) == ("retryable", "MIGRATION_MUTEX_RECOVERY")
    assert after["job-b"].finished_at == NOON
    lowered = conform.lower_enums(table, S.ENUM_COLUMNS["jobs"])
    assert by_id(queues.keep_one_running(lowered, NOW))["job-a"].status == "running"


def test_one_pending_job_is_kept_and_running_wins(spark):
    table = jobs(spark, [("job-a", "scan", "pending", datetime(2026, 1, 1)), ("job-b", "hash", "pending", datetime(2026, 1, 2))])
    after = by_id(queues.keep_one_active(table, NOW))
    assert after["job-a"].status == "pending"
    assert (after["job-b"].status, after["job-b"].error_code) == ("retryable", "MIGRATION_ACTIVE_RECOVERY")
    again = by_id(queues.keep_one_active(queues.keep_one_active(table, NOW), NOW))
    assert again["job-a"].status == "pending"
    late = jobs(spark, [("job-a", "scan", "pending", datetime(2026, 1, 1)), ("job-b", "hash", "running", datetime(2026, 1, 2))])
    after = by_id(queues.keep_one_active(late, NOW))
    assert (after["job-a"].status, after["job-b"].status) == ("retryable", "running")


def test_nothing_to_resolve(spark):
    table = jobs(spark, [("job-a", "scan", "completed", datetime(2026, 1, 1))])
    assert by_id(queues.keep_one_active(table, NOW))["job-a"].status == "completed"


def test_stale_lease_is_recovered(spark):
    table = jobs(spark, [("late", "scan", "running", NOON), ("live", "hash", "running", NOON), ("other", "delete", "running", NOON)])
    wait = F.when(F.col("id") == "live", 60).otherwise(-1)
    table = table.withColumns({"worker_id": F.lit("w"), "lease_expires_at": F.lit(NOON) + F.make_dt_interval(secs=wait)})
    after = by_id(queues.recover_stale_jobs(table, NOW))
    row = after["late"]
    assert (row.status, row.error_code, row.worker_id, row.lease_expires_at) == ("retryable", "LEASE_EXPIRED", None, None)
    assert row.error_message == "Lease expired and recovered by control plane"
    assert (after["live"].status, after["other"].status) == ("running", "running")


def test_job_pages(spark):
    table = jobs(spark, [(f"job-{i}", "delete", "pending", datetime(2026, 1, 1 + i // 3)) for i in range(8)])
    seen, cursor = [], None
    while True:
        page = queues.list_jobs(table, 3, cursor)
        seen += [r.id for r in page.items]
        if (cursor := page.next_cursor) is None:
            break
    assert seen == [f"job-{i}" for i in reversed(range(8))]
    with pytest.raises(InvalidCursor):
        queues.list_jobs(table, 3, "unknown")
    assert queues.list_jobs(table, 8).next_cursor is None


def test_work_is_seen_per_queue(spark):
    table = jobs(spark, [("a", "delete", "pending", NOON)])
    assert not queues.has_work("jobs", table, NOW)
    assert queues.has_work("jobs", jobs(spark, [("a", "hash", "pending", NOON)]), NOW)
    assert queues.runnable_work({"jobs": table}, NOW).first().has_work is False
    assert queues.runnable_work({"jobs": table.limit(0)}, NOW).first().has_work is False


def test_status_histogram_has_zeros(spark):
    rows = [(1, "completed", NOON), (2, "failed", None)]
    table = spark.createDataFrame(rows, "id long, status string, finished_at timestamp")
    row = queues.status_histogram(table, S.MAINTENANCE_STATUSES).first()
    assert (row.pending, row.running, row.retryable, row.completed, row.failed) == (0, 0, 0, 1, 1)
    assert row.latest_completed_at == NOON


def test_legacy_maintenance_rows(spark):
    old = spark.createDataFrame([(1, "RESTART", "RETRYABLE", NOON)], "id long, requested_mode string, status string, execute_after timestamp")
    table = conform.lower_enums(conform.conform(old, "wal_maintenance_jobs"), S.ENUM_COLUMNS["wal_maintenance_jobs"])
    row = conform.backfill_times(table, NOW).first()
    assert (row.requested_mode, row.status, row.retry_after, row.created_at) == ("restart", "retryable", NOON, NOON)


def test_conform_needs_a_key_and_drops_what_it_does_not_know(spark):
    with pytest.raises(ValueError):
        conform.conform(spark.createDataFrame([("x",)], "relative_path string"), "library_files")
    with pytest.raises(ValueError):
        conform.conform(spark.createDataFrame([(1,)], "id long"), "library_files")
    old = spark.createDataFrame([(1, 2, "p", 3, 4, "x")], "id int, library_id long, relative_path string, size_bytes long, mtime_ns long, legacy string")
    row = conform.conform(old, "library_files").first()
    assert (row.is_missing, row.needs_hash, row.hash_error_count, row.content_hash) == (False, True, 0, None)
    assert "legacy" not in row.asDict()


def test_illegal_transitions(spark, many_slices):
    log = [("j", 1, "pending"), ("j", 2, "running"), ("j", 3, "running"), ("j", 4, "completed"), ("j", 5, "pending"), ("k", 1, "retryable"), ("k", 2, "running")]
    df = spark.createDataFrame(log, "job string, at long, status string")
    bad = queues.illegal_transitions(df, "job", ["at"]).collect()
    assert sorted((r.job, r["at"], r.from_status, r.status) for r in bad) == [("j", 5, "completed", "pending"), ("k", 2, "retryable", "running")]


def test_maintenance_is_retried_later(spark):
    df = spark.createDataFrame([(1, "running", 2, " ")], "id long, status string, retry_count int, error_code string")
    df = df.withColumns({"lease_expires_at": F.lit(None).cast("timestamp"), "retry_after": F.lit(None).cast("timestamp")})
    row = queues.requeue_stale_with_retry(df, NOW).first()
    assert (row.status, row.retry_count, row.error_code) == ("retryable", 3, "LEASE_EXPIRED")
    assert row.retry_after == datetime(2026, 1, 10, 0, 2)


def test_error_digest_counts_all_and_shows_some(spark):
    rows = [("lib", "error", f"p{i:02d}", "denied") for i in range(25)] + [("lib", "file", "x", None)]
    df = spark.createDataFrame(rows, "library string, kind string, relative_path string, error string")
    row = stats.error_digest(df).first()
    assert row.error_count == 25 and row.error_message.count(" | ") == 19
    assert row.error_message.startswith("Scan encountered 25 filesystem access errors: /libraries/lib/p00: denied | /libraries/lib/p01")
    none = stats.error_digest(df.filter("kind = 'file'")).first()
    assert tuple(none) == (0, "Scan encountered 0 filesystem access errors")


def test_byte_totals_saturate(spark):
    rows = [("a", "file", 2**62), ("a", "file", 2**62), ("b", "file", 2**62)]
    df = spark.createDataFrame(rows, "library string, kind string, size_bytes long")
    totals = {r.library: r.bytes_seen for r in stats.scan_summary(df).collect()}
    assert totals == {"a": 2**63 - 1, "b": 2**62, None: 2**63 - 1}


def test_statistics_of_an_empty_log(spark):
    log = spark.createDataFrame([], "status string, thumb_key string, latency_ms double")
    row = stats.request_statistics(log, 0.0).first()
    assert (row.requests, row.throughput_rps, row.dedupe_ratio, row.latency_p95_ms) == (0, 0.0, 1.0, 0.0)
    failures = stats.threshold_failures(stats.request_statistics(log, 1.0), at_least={"throughput_rps": 250}, at_most={"failed_ratio": 0.001})
    assert [r.metric for r in failures.collect()] == ["throughput_rps"]


def test_unique_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "k string, n int")
    assert [tuple(r) for r in conform.duplicate_keys(df, ["k", "n"]).collect()] == [("a", 1, 2)]


def test_failures_only_touch_running_variants(spark):
    df = spark.createDataFrame([(1, "running", 3), (2, "ready", 0), (3, "running", 0)], "id long, status string, error_count int")
    df = conform.conform(df.withColumns({c: F.lit("x") for c in ("thumb_key", "media_type", "format")} | {c: F.lit(1) for c in ("file_id", "max_dimension", "source_size_bytes", "source_mtime_ns")}), "thumbnails")
    failures = spark.createDataFrame([(1, "C", "m"), (2, "C", "m")], "id long, error_code string, error_message string")
    after = by_id(queues.fail_with_backoff(df, failures, NOW))
    assert (after[1].status, after[1].error_count, after[1].retry_after) == ("failed", 4, datetime(2026, 1, 10, 0, 4))
    assert (after[2].status, after[3].status) == ("ready", "running")
