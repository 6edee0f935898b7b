"""Queue tables: paging, recovery, lifecycle and the shared I/O budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import NOW
from samebytes import schemas as S
from samebytes.operators import budget, queues, variants

_NOW = f"TIMESTAMP '{NOW}'"
_NOW_US = 1_705_363_200_000_000
_STALE = f"status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW})"
_WORK = "kind IN ('scan', 'hash')"


@check(
    "t3_job_page",
    "SELECT id, kind, status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50",
    "jobs",
)
def _(t):
    first = queues.list_jobs(t.jobs)
    return queues.job_page(t.jobs, cursor=first.items[-1].id).select("id", "kind", "status")


@check(
    "t4_next_jobs",
    f"SELECT id FROM jobs WHERE status = 'pending' AND {_WORK} ORDER BY created_at, id LIMIT 20",
    "jobs",
)
def _(t):
    return queues.next_jobs(t.jobs, 20).select("id")


@check(
    "t4_next_cleanups",
    f"""SELECT id FROM cleanups c WHERE status = 'pending' AND execute_after <= {_NOW}
 AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.group_key = c.group_key AND v.status IN ('pending', 'running')) ORDER BY execute_after, id LIMIT 20""",
    "cleanups variants",
)
def _(t):
    ready = variants.ready_cleanups(t.cleanups, t.variants, NOW)
    return queues.next_cleanups(ready, NOW, 20).select("id")


@check(
    "t4_next_maintenance",
    f"""SELECT id FROM maintenance WHERE (status = 'pending' AND execute_after <= {_NOW}) OR (status = 'retryable' AND (retry_after IS NULL OR retry_after <= {_NOW}))
 ORDER BY coalesce(retry_after, execute_after), id LIMIT 20""",
    "maintenance",
)
def _(t):
    return queues.next_maintenance(t.maintenance, NOW, 20).select("id")


@check(
    "t5_latest_row",
    """, m AS (SELECT * REPLACE (lower(status) AS status) FROM maintenance)
 (SELECT id, 'latest' AS which FROM m ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 1)
 UNION ALL (SELECT id, 'completed' FROM m WHERE status = 'completed' ORDER BY finished_at DESC NULLS LAST, id DESC LIMIT 1)
 UNION ALL (SELECT CAST(substr(id, 5) AS BIGINT), 'completed job' FROM jobs WHERE status = 'completed' ORDER BY finished_at DESC NULLS LAST, id DESC LIMIT 1)""",
    "maintenance jobs",
)
def _(t):
    number = F.substring("id", 5, 100).cast("bigint").alias("id")
    jobs = queues.latest_completed(t.jobs).select(number, F.lit("completed job").alias("which"))
    maintenance = t.maintenance.withColumn("status", F.lower("status"))
    latest = queues.latest_row(maintenance).select("id", F.lit("latest").alias("which"))
    done = queues.latest_completed(maintenance).select("id", F.lit("completed").alias("which"))
    return latest.unionByName(done).unionByName(jobs)


_JOB_COLUMNS = ("id", "status", "error_code", "error_message", "worker_id")


def _job_columns(df):
    return df.select(
        *_JOB_COLUMNS,
        F.unix_micros("lease_expires_at").alias("lease_us"),
        F.unix_micros("finished_at").alias("finished_us"),
    )


def _recovered(hit: str, code: str, message: str, finished: str, table: str = "jobs") -> str:
    return f"""SELECT id, CASE WHEN {hit} THEN 'retryable' ELSE status END AS status, CASE WHEN {hit} THEN {code} ELSE error_code END AS error_code,
 CASE WHEN {hit} THEN {message} ELSE error_message END AS error_message, CASE WHEN NOT ({hit}) THEN worker_id END AS worker_id,
 CASE WHEN NOT ({hit}) THEN epoch_us(lease_expires_at) END AS lease_us, CASE WHEN {hit} THEN {finished} ELSE epoch_us(finished_at) END AS finished_us FROM {table}"""


def _blank(column: str, default: str) -> str:
    return f"CASE WHEN {column} IS NULL OR trim({column}) = '' THEN '{default}' ELSE {column} END"


@check(
    "u1_recover_stale_jobs",
    _recovered(f"{_STALE} AND {_WORK}", f"'{S.LEASE_EXPIRED}'", f"'{S.LEASE_EXPIRED_CONTROL_MESSAGE}'", str(_NOW_US)),
    "jobs",
)
def _(t):
    return _job_columns(queues.recover_stale_jobs(t.jobs, NOW))


@check(
    "u1_recover_stale_jobs_claim",
    _recovered(
        f"{_STALE} AND {_WORK}",
        _blank("error_code", S.LEASE_EXPIRED),
        _blank("error_message", S.LEASE_EXPIRED_CLAIM_MESSAGE),
        f"coalesce(epoch_us(finished_at), {_NOW_US})",
    ),
    "jobs",
)
def _(t):
    return _job_columns(queues.recover_stale_jobs(t.jobs, NOW, overwrite=False))


def _requeued(table: str) -> str:
    return f"""SELECT '{table}' AS queue, id, CASE WHEN {_STALE} THEN 'pending' ELSE status END AS status,
 CASE WHEN {_STALE} THEN {_blank('error_code', S.LEASE_EXPIRED)} ELSE error_code END AS error_code,
 CASE WHEN NOT ({_STALE}) THEN epoch_us(lease_expires_at) END AS lease_us FROM {table}"""


@check(
    "u2_requeue_stale",
    _requeued("variants") + " UNION ALL " + _requeued("cleanups"),
    "variants cleanups",
)
def _(t):
    def columns(name, df):
        lease = F.unix_micros("lease_expires_at").alias("lease_us")
        return df.select(F.lit(name).alias("queue"), "id", "status", "error_code", lease)

    return columns("variants", queues.requeue_stale(t.variants, NOW)).unionByName(
        columns("cleanups", queues.requeue_stale(t.cleanups, NOW, clear_finished=True))
    )


@check(
    "u3_requeue_with_retry",
    f"""SELECT id, CASE WHEN {_STALE} THEN 'retryable' ELSE status END AS status, CASE WHEN {_STALE} THEN retry_count + 1 ELSE retry_count END AS retry_count,
 CASE WHEN {_STALE} THEN {_NOW_US} + 120000000 ELSE epoch_us(retry_after) END AS retry_us, CASE WHEN {_STALE} THEN {_blank('error_code', S.LEASE_EXPIRED)} ELSE error_code END AS error_code,
 CASE WHEN NOT ({_STALE}) THEN epoch_us(finished_at) END AS finished_us FROM maintenance""",
    "maintenance",
)
def _(t):
    after = queues.requeue_stale_with_retry(t.maintenance, NOW)
    return after.select(
        "id", "status", "retry_count", F.unix_micros("retry_after").alias("retry_us"), "error_code",
        F.unix_micros("finished_at").alias("finished_us"),
    )


@check(
    "u4_fail_with_backoff",
    f"""SELECT v.id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN error_count + 1 ELSE error_count END AS error_count,
 CASE WHEN hit THEN 'THUMB_DECODE_FAILED' ELSE error_code END AS error_code,
 CASE WHEN hit THEN {_NOW_US} + 1000000 * least(30 * CAST(2 ** error_count AS BIGINT), 1800) ELSE epoch_us(retry_after) END AS retry_us
 FROM (SELECT v.*, v.status = 'running' AND l.doc_id IS NOT NULL AS hit FROM variants v LEFT JOIN labels l ON l.doc_id = v.id) v""",
    "variants",
)
def _(t):
    failures = t.labels.select(
        F.col("doc_id").alias("id"),
        F.lit("THUMB_DECODE_FAILED").alias("error_code"),
        F.lit("cannot decode").alias("error_message"),
    )
    after = queues.fail_with_backoff(t.variants, failures, NOW)
    return after.select("id", "status", "error_count", "error_code", F.unix_micros("retry_after").alias("retry_us"))


@check(
    "w1_keep_one_running",
    f", d AS (SELECT *, {_WORK} AND status = 'running' AND row_number() OVER (PARTITION BY {_WORK} AND status = 'running' ORDER BY created_at, id) > 1 AS hit FROM jobs)"
    + _recovered("hit", f"'{S.MUTEX_RECOVERY}'", _blank("error_message", S.MUTEX_RECOVERY_MESSAGE), f"coalesce(epoch_us(finished_at), {_NOW_US})", "d"),
    "jobs",
)
def _(t):
    return _job_columns(queues.keep_one_running(t.jobs, NOW))


@check(
    "w2_keep_one_active",
    f", d AS (SELECT *, {_WORK} AND status IN ('running', 'pending') AND row_number() OVER (PARTITION BY {_WORK} AND status IN ('running', 'pending') ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, created_at, id) > 1 AS hit FROM jobs)"
    + _recovered("hit", _blank("error_code", S.ACTIVE_RECOVERY), _blank("error_message", S.ACTIVE_RECOVERY_MESSAGE), f"coalesce(epoch_us(finished_at), {_NOW_US})", "d"),
    "jobs",
)
def _(t):
    return _job_columns(queues.keep_one_active(t.jobs, NOW))


_LOG = "SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'retryable' END AS status FROM {events}"


@check(
    "w6_illegal_transitions",
    "WITH log AS ("
    + _LOG.format(events="events")
    + """), s AS (SELECT event_id, job_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM log)
 SELECT event_id, job_id, from_status, status FROM s WHERE from_status <> status
 AND NOT from_status || '>' || status IN ("""
    + ", ".join(f"'{a}>{b}'" for a, b in S.JOB_TRANSITIONS)
    + ")",
)
def _(t):
    log = t.spark.sql(_LOG, events=t.events)
    return queues.illegal_transitions(log, "job_id", ["ts", "event_id"]).select(
        "event_id", "job_id", "from_status", "status"
    )


@check(
    "a6_status_histogram",
    """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'retryable') AS retryable,
 count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, epoch_us(max(finished_at) FILTER (status = 'completed')) AS latest_completed_us
 FROM (SELECT * REPLACE (lower(status) AS status) FROM maintenance)""",
    "maintenance",
)
def _(t):
    table = t.maintenance.withColumn("status", F.lower("status"))
    counts = queues.status_histogram(table, S.MAINTENANCE_STATUSES)
    return counts.withColumn("latest_completed_us", F.unix_micros("latest_completed_at")).drop("latest_completed_at")


def _reads(t, bucket: str):
    return t.requests.select(
        F.expr(bucket).alias("bucket_key"), "seq", F.unix_millis("requested_at").alias("now_ms"), "bytes"
    )


def _schedule_sql(bucket: str) -> str:
    return f""", r AS (SELECT {bucket} AS bucket_key, seq, epoch_us(requested_at) // 1000 AS now_ms, greatest((bytes * 1000 + 1048575) // 1048576, 1) AS budget_ms FROM requests WHERE bytes > 0),
 c AS (SELECT *, CAST(sum(budget_ms) OVER w AS BIGINT) AS total FROM r WINDOW w AS (PARTITION BY bucket_key ORDER BY now_ms, seq)),
 e AS (SELECT *, total + greatest(max(now_ms - (total - budget_ms)) OVER (PARTITION BY bucket_key ORDER BY now_ms, seq), 0) AS end_ms FROM c)
 SELECT bucket_key, seq, budget_ms, end_ms - budget_ms AS start_ms, greatest(end_ms - budget_ms - now_ms, 0) AS delay_ms, end_ms FROM e
 UNION ALL SELECT {bucket}, seq, 0, epoch_us(requested_at) // 1000, 0, epoch_us(requested_at) // 1000 FROM requests WHERE bytes <= 0"""


@check("w4_io_schedule", _schedule_sql("'thumbnail_io_global'"), "requests")
def _(t):
    schedule = budget.io_schedule(_reads(t, "'thumbnail_io_global'"), 1, order=["now_ms", "seq"])
    return schedule.select("bucket_key", "seq", "budget_ms", "start_ms", "delay_ms", "end_ms")


@check("w4_io_schedule_buckets", _schedule_sql("'disk-' || file_id % 7"), "requests")
def _(t):
    schedule = budget.io_schedule(_reads(t, "concat('disk-', file_id % 7)"), 1, order=["now_ms", "seq"])
    return schedule.select("bucket_key", "seq", "budget_ms", "start_ms", "delay_ms", "end_ms")
