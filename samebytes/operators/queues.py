"""Questions and repairs over queue tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes import schemas as S
from samebytes.functions.common import as_timestamp, default_if_blank, seconds
from samebytes.functions.cursors import InvalidCursor, page_limit
from samebytes.functions.numbers import retry_delay_seconds
from samebytes.functions.predicates import (
    Clock,
    due,
    runnable_cleanup,
    runnable_job,
    runnable_maintenance,
    runnable_variant,
    stale_lease,
)
from samebytes.operators.duplicates import Page
from samebytes.operators.scale import first_rows, lookup_join, with_previous

LEASE_FIELDS = ("worker_id", "worker_heartbeat_at", "lease_expires_at")


def runnable_work(queues: dict[str, DataFrame], now: Clock) -> DataFrame:
    """P5: one row per queue (jobs, variants, cleanups, maintenance) saying if work is due."""
    tests = {
        "jobs": runnable_job,
        "variants": runnable_variant,
        "cleanups": runnable_cleanup,
        "maintenance": runnable_maintenance,
    }
    answers = [
        table.agg(F.coalesce(F.max(tests[name](now)), F.lit(False)).alias("has_work")).select(
            F.lit(name).alias("queue"), "has_work"
        )
        for name, table in queues.items()
    ]
    result = answers[0]
    for answer in answers[1:]:
        result = result.unionByName(answer)
    return result


def has_work(queue: str, table: DataFrame, now: Clock) -> bool:
    """P5 for one queue: stops at the first runnable row."""
    tests = {
        "jobs": runnable_job,
        "variants": runnable_variant,
        "cleanups": runnable_cleanup,
        "maintenance": runnable_maintenance,
    }
    return not table.filter(tests[queue](now)).limit(1).isEmpty()


def job_page(jobs: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Newest jobs first; the cursor is the id of the last job already seen."""
    if cursor:
        micros = F.unix_micros("created_at").alias("at")
        anchor = jobs.filter(F.col("id") == cursor).select(micros).first()
        if anchor is None:
            raise InvalidCursor(f"no job has the id {cursor}")
        at = F.timestamp_micros(F.lit(anchor["at"]))
        jobs = jobs.filter(
            (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < cursor))
        )
    newest = jobs.orderBy(F.desc("created_at"), F.desc("id"))
    return newest.limit(page_limit(limit, S.JOB_PAGE_SIZE))


def list_jobs(jobs: DataFrame, limit: int | None = None, cursor: str | None = None) -> Page:
    """T3 as a request."""
    size = page_limit(limit, S.JOB_PAGE_SIZE)
    rows = job_page(jobs, size, cursor).collect()
    # A further row exists exactly if the page after this one is not empty.
    more = len(rows) == size and not job_page(jobs, 1, rows[-1].id).isEmpty()
    return Page(rows, rows[-1].id if more else None)


def next_jobs(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """T4: oldest pending scan and hash jobs."""
    waiting = jobs.filter((F.col("status") == "pending") & F.col("kind").isin("scan", "hash"))
    return first_rows(waiting, ["created_at", "id"], limit)


def next_cleanups(cleanups: DataFrame, now: Clock, limit: int = 1) -> DataFrame:
    """T4: longest due cleanups; pass the result of `ready_cleanups` to skip busy groups."""
    waiting = (F.col("status") == "pending") & (F.col("execute_after") <= as_timestamp(now))
    return first_rows(cleanups.filter(waiting), ["execute_after", "id"], limit)


def next_maintenance(maintenance: DataFrame, now: Clock, limit: int = 1) -> DataFrame:
    """T4: due maintenance, pending or to be retried."""
    pending = (F.col("status") == "pending") & (F.col("execute_after") <= as_timestamp(now))
    again = (F.col("status") == "retryable") & due("retry_after", now)
    order = [F.coalesce("retry_after", "execute_after"), F.col("id")]
    return first_rows(maintenance.filter(pending | again), order, limit)


def latest_row(table: DataFrame) -> DataFrame:
    """T5: newest row by creation; a top-1, so no sort of the table."""
    return table.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def latest_completed(table: DataFrame) -> DataFrame:
    """T5: row that completed last."""
    done = table.filter(F.col("status") == "completed")
    return done.orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(1)


def _recovered(
    df: DataFrame,
    hit: Column,
    now: Clock,
    *,
    status: str,
    code: Column,
    message: Column,
    finished: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Rewrite the rows where `hit` holds; columns a table lacks are skipped."""
    values = {
        "status": F.lit(status),
        **{name: F.lit(None) for name in LEASE_FIELDS},
        "error_code": code,
        "error_message": message,
        "updated_at": as_timestamp(now),
        **(extra or {}),
    }
    if finished is not None:
        values["finished_at"] = finished
    return df.select(
        *[
            F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in values
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _kept_or(df: DataFrame, column: str, default: str) -> Column:
    return default_if_blank(column, default) if column in df.columns else F.lit(default)


def recover_stale_jobs(jobs: DataFrame, now: Clock, *, overwrite: bool = True) -> DataFrame:
    """Stale scan and hash jobs become retryable.

    `overwrite` replaces errors and finish times, as the control plane does; otherwise stored
    ones win, as in a worker's claim.
    """
    clock = as_timestamp(now)
    if overwrite:
        code, message = F.lit(S.LEASE_EXPIRED), F.lit(S.LEASE_EXPIRED_CONTROL_MESSAGE)
        finished = clock
    else:
        code = _kept_or(jobs, "error_code", S.LEASE_EXPIRED)
        message = _kept_or(jobs, "error_message", S.LEASE_EXPIRED_CLAIM_MESSAGE)
        finished = F.coalesce("finished_at", clock) if "finished_at" in jobs.columns else None
    hit = stale_lease(now, ("scan", "hash"))
    return _recovered(
        jobs, hit, now, status="retryable", code=code, message=message, finished=finished
    )


def requeue_stale(df: DataFrame, now: Clock, *, clear_finished: bool = False) -> DataFrame:
    """Stale variants, or with `clear_finished` stale cleanups, are pending again."""
    return _recovered(
        df,
        stale_lease(now),
        now,
        status="pending",
        code=_kept_or(df, "error_code", S.LEASE_EXPIRED),
        message=_kept_or(df, "error_message", S.LEASE_EXPIRED_REQUEUE_MESSAGE),
        finished=F.lit(None) if clear_finished else None,
    )


def requeue_stale_with_retry(
    df: DataFrame, now: Clock, retry_seconds: int = S.MAINTENANCE_RETRY_SECONDS
) -> DataFrame:
    """Stale maintenance is retried later and counts the attempt."""
    return _recovered(
        df,
        stale_lease(now),
        now,
        status="retryable",
        code=_kept_or(df, "error_code", S.LEASE_EXPIRED),
        message=_kept_or(df, "error_message", S.LEASE_EXPIRED_REQUEUE_MESSAGE),
        finished=F.lit(None),
        extra={
            "retry_count": F.coalesce("retry_count", F.lit(0)) + 1,
            "retry_after": as_timestamp(now) + seconds(retry_seconds),
        },
    )


def fail_with_backoff(
    variants: DataFrame,
    failures: DataFrame,
    now: Clock,
    retry: tuple[int, int] = S.VARIANT_RETRY_SECONDS,
) -> DataFrame:
    """U4: running variants listed in `failures` (id, error_code, error_message) fail.

    Each failure lengthens the wait before the next attempt.
    """
    clock = as_timestamp(now)
    errors = failures.select(
        F.col("id").alias("_id"),
        F.col("error_code").alias("_code"),
        F.col("error_message").alias("_message"),
    )
    joined = lookup_join(variants, errors, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") == "running")
    count = F.coalesce("error_count", F.lit(0)) + 1
    values = {
        "status": F.lit("failed"),
        "error_count": count,
        "error_code": F.col("_code"),
        "error_message": F.col("_message"),
        "retry_after": clock + seconds(retry_delay_seconds(count, *retry)),
        "finished_at": clock,
        "worker_heartbeat_at": clock,
        "lease_expires_at": F.lit(None),
        "updated_at": clock,
    }
    return joined.select(
        *[
            F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            if f.name in values
            else F.col(f.name)
            for f in variants.schema
        ]
    )


def _keep_oldest(
    jobs: DataFrame, now: Clock, member: Column, order: Column, code: Column, message: Column
) -> DataFrame:
    """All members but the first by `order` become retryable.

    The winner is a minimum, so it needs no ranking and no single-task window.
    """
    winner = jobs.filter(member).agg(F.min_by("id", order).alias("id")).scalar()
    finished = (
        F.coalesce("finished_at", as_timestamp(now)) if "finished_at" in jobs.columns else None
    )
    return _recovered(
        jobs,
        member & (F.col("id") != winner),
        now,
        status="retryable",
        code=code,
        message=message,
        finished=finished,
    )


def keep_one_running(jobs: DataFrame, now: Clock) -> DataFrame:
    """At most one scan or hash job runs, the oldest."""
    member = (F.lower("status") == "running") & F.lower("kind").isin("scan", "hash")
    return _keep_oldest(
        jobs,
        now,
        member,
        F.struct("created_at", "id"),
        F.lit(S.MUTEX_RECOVERY),
        _kept_or(jobs, "error_message", S.MUTEX_RECOVERY_MESSAGE),
    )


def keep_one_active(jobs: DataFrame, now: Clock) -> DataFrame:
    """At most one scan or hash job waits or runs; running wins, then the oldest."""
    status = F.lower("status")
    member = status.isin("pending", "running") & F.lower("kind").isin("scan", "hash")
    rank = F.when(status == "running", F.lit(0)).otherwise(F.lit(1)).alias("rank")
    return _keep_oldest(
        jobs,
        now,
        member,
        F.struct(rank, "created_at", "id"),
        _kept_or(jobs, "error_code", S.ACTIVE_RECOVERY),
        _kept_or(jobs, "error_message", S.ACTIVE_RECOVERY_MESSAGE),
    )


def illegal_transitions(
    log: DataFrame,
    key: str,
    order: list[str],
    allowed: Iterable[tuple[str, str]] = S.JOB_TRANSITIONS,
) -> DataFrame:
    """Status changes of a log (key, order columns, status) that are not allowed.

    Entries that repeat the status before them are no change.
    """
    steps = with_previous(log, key, order, {"status": "from_status"})
    legal = F.concat_ws(">", "from_status", "status").isin(*[f"{a}>{b}" for a, b in allowed])
    changed = F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status"))
    return steps.filter(changed & ~legal)


def status_histogram(table: DataFrame, statuses: Iterable[str]) -> DataFrame:
    """One row with a count per status, zeros included, and the latest completion."""
    completed = F.when(F.col("status") == "completed", F.col("finished_at"))
    return table.agg(
        *[F.count_if(F.col("status") == status).alias(status) for status in statuses],
        F.max(completed).alias("latest_completed_at"),
    )
