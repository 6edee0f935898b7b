"""Picking files to hash and applying the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.functions.common import as_timestamp, seconds
from samebytes.functions.numbers import retry_delay_seconds
from samebytes.functions.predicates import Clock, hash_candidate
from samebytes.operators.merge import GONE_STATE, HASH_STATE, SEEN, typed
from samebytes.operators.scale import first_rows, lookup_join
from samebytes.schemas import HASH_CLAIM_TTL_SECONDS, HASH_RETRY_SECONDS, LIBRARY_FILES


def next_hash_files(
    catalog: DataFrame,
    now: Clock,
    limit: int | None = None,
    claim_ttl_seconds: int = HASH_CLAIM_TTL_SECONDS,
) -> DataFrame:
    """Due candidates, the first `limit` of them by id when a limit is given."""
    due = catalog.filter(hash_candidate(now, claim_ttl_seconds))
    return due if limit is None else first_rows(due, ["id"], limit)


def with_root(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """What a hashing task has to know about each candidate."""
    paths = roots.select(F.col("id").alias("library_id"), "root_path")
    return lookup_join(candidates, paths, "library_id").select(
        "id",
        "relative_path",
        F.col("size_bytes").alias("expected_size"),
        F.col("mtime_ns").alias("expected_mtime_ns"),
        F.coalesce("hash_error_count", F.lit(0)).alias("hash_error_count"),
        "root_path",
    )


def apply_outcomes(
    catalog: DataFrame,
    outcomes: DataFrame,
    *,
    algorithm: str,
    now: Clock,
    retry: tuple[int, int] = HASH_RETRY_SECONDS,
) -> DataFrame:
    """The catalog after hashing; `outcomes` has at most one row per id.

    hashed: digest and hashed stat stored; requeued: new stat stored and hash state dropped;
    missing: marked gone; failed: error stored and retried later.
    """
    used = ("id", "outcome", "digest", "error", *SEEN)
    results = outcomes.select(*[F.col(c).alias(f"_{c}") for c in used])
    joined = lookup_join(catalog, results, F.col("id") == F.col("_id"), "left")
    outcome = F.col("_outcome")
    hashed, requeued = outcome == "hashed", outcome == "requeued"
    missing, failed = outcome == "missing", outcome == "failed"
    fresh = hashed | requeued
    stamp = as_timestamp(now)
    failures = F.coalesce("hash_error_count", F.lit(0)) + 1
    delay = retry_delay_seconds(failures, *retry)

    updates: dict[str, list[tuple[Column, Column]]] = {
        f.name: [] for f in LIBRARY_FILES
    }
    for name in SEEN:
        updates[name].append((requeued, F.col(f"_{name}")))
    for name, empty in HASH_STATE.items():
        updates[name].append((requeued, typed(name, empty)))
    for name in GONE_STATE:
        updates[name].append((missing, typed(name, None)))
    for name, value in {
        "hash_algorithm": F.lit(algorithm),
        "content_hash": F.col("_digest"),
        "hashed_size_bytes": F.col("_size_bytes"),
        "hashed_mtime_ns": F.col("_mtime_ns"),
        "hashed_at": stamp,
        "hash_error_count": F.lit(0),
        "hash_last_error": typed("hash_last_error", None),
        "hash_last_error_at": typed("hash_last_error_at", None),
        "hash_retry_after": typed("hash_retry_after", None),
        "hash_claim_token": typed("hash_claim_token", None),
        "hash_claimed_at": typed("hash_claimed_at", None),
    }.items():
        updates[name].append((hashed, value))
    for name, value in {
        "hash_error_count": failures.cast("int"),
        "hash_last_error": F.col("_error"),
        "hash_last_error_at": stamp,
        "hash_retry_after": stamp + seconds(delay),
        "hash_claim_token": typed("hash_claim_token", None),
        "hash_claimed_at": typed("hash_claimed_at", None),
    }.items():
        updates[name].append((failed, value))
    updates["is_missing"] += [(missing, F.lit(True)), (fresh, F.lit(False))]
    updates["needs_hash"] += [(requeued | failed, F.lit(True)), (hashed | missing, F.lit(False))]
    updates["updated_at"].append((outcome.isNotNull(), stamp))

    def final(name: str) -> Column:
        value = F.col(name)
        for condition, replacement in updates[name]:
            value = F.when(condition, replacement).otherwise(value)
        return value.alias(name)

    return joined.select(*[final(f.name) for f in LIBRARY_FILES])


def hash_summary(outcomes: DataFrame) -> DataFrame:
    """A4: counts per outcome and bytes hashed, in one pass."""
    outcome = F.col("outcome")
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        *[
            F.count_if(outcome == name).alias(name)
            for name in ("hashed", "requeued", "missing", "failed")
        ],
        saturated_sum(F.when(outcome == "hashed", F.col("bytes_hashed"))).alias("bytes_hashed"),
    )


def saturated_sum(value: Column) -> Column:
    """A byte total that stops at the largest 64-bit integer instead of failing."""
    total = F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return F.least(total, F.lit(2**63 - 1).cast("decimal(30,0)")).cast("bigint")
