"""Row predicates of the catalog and its queues."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.functions.common import as_timestamp, col, seconds
from samebytes.schemas import HASH_CLAIM_TTL_SECONDS

Clock = Column | datetime | str


def dedup_eligible() -> Column:
    """Present, hashed and not waiting for another hash. Pushes down to Parquet."""
    return (
        ~F.col("is_missing")
        & ~F.col("needs_hash")
        & F.col("hash_algorithm").isNotNull()
        & F.col("content_hash").isNotNull()
    )


def metadata_changed(old: str, new: str) -> Column:
    """Stat fields of the `new` row differ from those of the `old`, or the file had gone.

    The sides are column prefixes such as `old.` or `n_`. A NULL inode or device counts as -1
    on both of them.
    """

    def known(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}{name}"), F.lit(-1).cast("bigint"))

    return (
        (F.col(f"{old}size_bytes") != F.col(f"{new}size_bytes"))
        | (F.col(f"{old}mtime_ns") != F.col(f"{new}mtime_ns"))
        | (known(old, "inode") != known(new, "inode"))
        | (known(old, "device") != known(new, "device"))
        | F.col(f"{old}is_missing")
    )


def due(at: Column | str, now: Clock) -> Column:
    """NULL means immediately."""
    at = col(at)
    return at.isNull() | (at <= as_timestamp(now))


def hash_candidate(now: Clock, claim_ttl_seconds: int = HASH_CLAIM_TTL_SECONDS) -> Column:
    """Waiting for a hash, due, and not held by a live claim."""
    expiry = as_timestamp(now) - seconds(claim_ttl_seconds)
    unclaimed = (
        F.col("hash_claim_token").isNull()
        | F.col("hash_claimed_at").isNull()
        | (F.col("hash_claimed_at") <= expiry)
    )
    return (
        F.col("needs_hash") & ~F.col("is_missing") & due("hash_retry_after", now) & unclaimed
    )


def stale_lease(now: Clock, kinds: Iterable[str] | None = None) -> Column:
    """Running, but the lease is absent or over."""
    stale = (F.col("status") == "running") & due("lease_expires_at", now)
    return stale if kinds is None else stale & F.col("kind").isin(*kinds)


def runnable_job(now: Clock) -> Column:
    """P5 for the job queue: only scan and hash jobs are worked off."""
    return F.col("kind").isin("scan", "hash") & (
        (F.col("status") == "pending") | stale_lease(now)
    )


def runnable_variant(now: Clock) -> Column:
    """P5 for the variant queue."""
    return ((F.col("status") == "pending") & due("retry_after", now)) | stale_lease(now)


def runnable_cleanup(now: Clock) -> Column:
    """P5 for the cleanup queue."""
    waiting = (F.col("status") == "pending") & (F.col("execute_after") <= as_timestamp(now))
    return waiting | stale_lease(now)


def runnable_maintenance(now: Clock) -> Column:
    """P5 for the maintenance queue."""
    retry = (F.col("status") == "retryable") & due("retry_after", now)
    return runnable_cleanup(now) | retry


def valid_enum(value: Column | str, allowed: Iterable[str]) -> Column:
    """Never NULL, so it can be negated safely."""
    return F.coalesce(col(value).isin(*allowed), F.lit(False))


def split_rejects(
    df: DataFrame, enums: dict[str, Iterable[str]], nullable: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Rows whose enumerated columns are all legal, and the rest with the column names."""
    optional = set(nullable)
    bad = [
        F.when(
            ~valid_enum(name, allowed)
            & (F.col(name).isNotNull() if name in optional else F.lit(True)),
            F.lit(name),
        )
        for name, allowed in enums.items()
    ]
    invalid = F.concat_ws(",", *bad)
    return df.filter(invalid == ""), df.filter(invalid != "").withColumn("invalid", invalid)


def source_unchanged(planned: str, observed: str) -> Column:
    """P10: size and modification time are still the recorded ones."""
    return F.coalesce(
        (F.col(f"{planned}.source_size_bytes") == F.col(f"{observed}.size_bytes"))
        & (F.col(f"{planned}.source_mtime_ns") == F.col(f"{observed}.mtime_ns")),
        F.lit(False),
    )
