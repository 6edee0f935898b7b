"""Merging a scan into the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.functions.common import as_timestamp
from samebytes.functions.predicates import Clock, metadata_changed
from samebytes.operators.scale import (
    BROADCAST_ROWS,
    fits_broadcast,
    lookup_join,
    rows_not_in,
    with_position,
)
from samebytes.schemas import LIBRARY_FILES, LIBRARY_ROOTS

KEY = ["library_id", "relative_path"]
SEEN = ["size_bytes", "mtime_ns", "inode", "device"]

# Columns that describe a hash; they are void once the content may have changed.
HASH_STATE = {
    "hash_algorithm": None,
    "content_hash": None,
    "hashed_size_bytes": None,
    "hashed_mtime_ns": None,
    "hashed_at": None,
    "hash_error_count": 0,
    "hash_last_error": None,
    "hash_last_error_at": None,
    "hash_retry_after": None,
    "hash_claim_token": None,
    "hash_claimed_at": None,
}

# Columns that are cleared, besides `needs_hash`, when a file is found to be gone.
GONE_STATE = ("hash_claim_token", "hash_claimed_at", "hash_retry_after")


def typed(name: str, value: object) -> Column:
    return F.lit(value).cast(LIBRARY_FILES[name].dataType)


def newest_per_key(scan: DataFrame) -> DataFrame:
    """One row per file: of several, the one with the newest modification time, then the largest."""
    last = F.max_by(F.struct(*SEEN), F.struct("mtime_ns", "size_bytes", "inode", "device"))
    return scan.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.*")


def _joined(
    catalog: DataFrame,
    scan: DataFrame,
    scanned: DataFrame,
    complete: bool,
    small: bool = False,
    small_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Catalog and scan side by side (`o_`, `n_`) with the kind of change per file."""
    old = catalog.select(*[F.col(c).alias(f"o_{c}") for c in catalog.columns])
    new = scan.select(*[F.col(c).alias(f"n_{c}") for c in scan.columns])
    old = old.withColumn("_old", F.lit(True))
    new = new.withColumn("_new", F.lit(True))
    same = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in KEY]
    if small:
        # Known files look up the scan; all others are new, whether or not they have an id.
        known = old.join(F.broadcast(new), same, "left")
        nothing = old.filter(F.lit(False))
        unknown = rows_not_in(scan, catalog, KEY, small_rows).select(
            *[F.col(c).alias(f"n_{c}") for c in scan.columns], F.lit(True).alias("_new")
        )
        added = unknown.join(nothing, same, "left").select(*known.columns)
        both = known.unionByName(added)
    else:
        both = old.join(new, same, "full_outer")
    targets = scanned.select(F.col("library_id").alias("_target")).distinct()
    both = lookup_join(both, targets, F.col("o_library_id") == F.col("_target"), "left")
    gone = F.col("_target").isNotNull() & ~F.col("o_is_missing") & F.lit(complete)
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), F.when(gone, "missing").otherwise("untouched"))
        .when(F.col("o_is_missing"), "reappeared")
        .when(metadata_changed("o_", "n_"), "changed")
        .otherwise("unchanged")
    )
    return both.withColumn("change", change)


def merge_scan(
    catalog: DataFrame,
    scan: DataFrame,
    scanned: DataFrame,
    *,
    scan_id: int,
    now: Clock,
    complete: bool = True,
    new_ids: DataFrame | None = None,
    small_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The catalog after a scan, plus a `change` column.

    Of several rows of a file in `scan` the newest counts; `scanned` lists the library ids that were walked, including
    empty ones; `complete` is false when the scan met any error, and then nothing is marked
    missing. `new_ids` comes from `assign_ids`; inserted rows without one there keep a NULL id, and
    ids of files the catalog knows by now are not used.

    The join runs on (library_id, relative_path), which is unique, so no partition is hot. A
    catalog bucketed on that key is not shuffled, and neither is any catalog when the scan is
    small and has its ids, as the batches of a stream do.
    """
    scan = newest_per_key(scan)
    small = new_ids is not None and fits_broadcast(scan, small_rows)
    if new_ids is None:
        scan = scan.withColumn("_id", F.lit(None).cast("bigint"))
    else:
        # Same keys as the merge itself, so the scan is shuffled once for both joins.
        ids = new_ids.groupBy(*KEY).agg(F.min("id").alias("_id"))
        scan = scan.join(ids, KEY, "left")
    joined = _joined(catalog, scan, scanned, complete, small, small_rows)

    change = F.col("change")
    seen = F.col("_new").isNotNull()
    missing = change == "missing"
    stale = change.isin("added", "changed", "reappeared")
    stamp = as_timestamp(now)

    out: dict[str, Column] = {
        "id": F.coalesce("o_id", "n__id"),
        **{k: F.coalesce(f"n_{k}", f"o_{k}") for k in KEY},
        **{c: F.when(seen, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in SEEN},
        "is_missing": F.when(seen, False).when(missing, True).otherwise(F.col("o_is_missing")),
        "needs_hash": F.when(stale, True).when(missing, False).otherwise(F.col("o_needs_hash")),
        "last_seen_scan_id": F.when(seen, F.lit(scan_id).cast("bigint")).otherwise(
            F.col("o_last_seen_scan_id")
        ),
        "created_at": F.when(change == "added", stamp).otherwise(F.col("o_created_at")),
        "updated_at": F.when(change != "untouched", stamp).otherwise(F.col("o_updated_at")),
    }
    for name, empty in HASH_STATE.items():
        reset = stale | missing if name in GONE_STATE else stale
        out[name] = F.when(reset, typed(name, empty)).otherwise(F.col(f"o_{name}"))
    return joined.select(*[out[f.name].alias(f.name) for f in LIBRARY_FILES], "change")


def scan_changes(
    catalog: DataFrame, scan: DataFrame, scanned: DataFrame, *, complete: bool = True
) -> DataFrame:
    """What a scan would do to each file, reading only keys and stat columns."""
    slim = catalog.select("id", *KEY, *SEEN, "is_missing")
    joined = _joined(slim, newest_per_key(scan), scanned, complete)
    keys = [F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in KEY]
    return joined.select(F.col("o_id").alias("id"), *keys, "change")


def missing_files(catalog: DataFrame, scan: DataFrame, scanned: DataFrame) -> DataFrame:
    """J2 as a report: present files of walked libraries that a complete scan did not see."""
    targets = scanned.select("library_id").distinct()
    present = lookup_join(catalog.filter(~F.col("is_missing")), targets, "library_id", "left_semi")
    return present.join(scan.select(*KEY), KEY, "left_anti")


def assign_ids(catalog: DataFrame, scan: DataFrame, largest: int | None = None) -> DataFrame:
    """Ids for files the catalog does not know, dense after its largest id, by key.

    Only keys are read from the catalog; only new keys are ranked, in range slices. A file that
    the scan has several times gets one id. `largest` is given where `catalog` is a part of the
    whole one, as long as it holds every file of the scan that is known.
    """
    added = rows_not_in(scan.select(*KEY).distinct(), catalog, KEY)
    placed = with_position(added, KEY, "_rank")
    top = F.lit(largest) if largest is not None else catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    return placed.select(*KEY, (top + F.col("_rank") + 1).cast("bigint").alias("id"))


def register_roots(roots: DataFrame, discovered: DataFrame, now: Clock) -> DataFrame:
    """Libraries by name; a known one gets its new path, a new one the next id."""
    found = discovered.select(F.col("name"), F.col("root_path").alias("_path"))
    new = with_position(found.join(roots.select("name"), "name", "left_anti"), ["name"], "_rank")
    largest = roots.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    stamp = as_timestamp(now)
    inserted = new.select(
        (largest + F.col("_rank") + 1).cast("bigint").alias("id"),
        "name",
        F.col("_path").alias("root_path"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("last_scanned_at"),
    )
    kept = roots.join(found, "name", "left").select(
        "id",
        "name",
        F.coalesce("_path", "root_path").alias("root_path"),
        "created_at",
        F.when(F.col("_path").isNotNull(), stamp).otherwise(F.col("updated_at")).alias(
            "updated_at"
        ),
        "last_scanned_at",
    )
    return kept.unionByName(inserted).select(*LIBRARY_ROOTS.fieldNames())


def stamp_scanned_roots(roots: DataFrame, scanned: DataFrame, now: Clock) -> DataFrame:
    """Set `last_scanned_at` of the walked libraries after a complete scan."""
    targets = scanned.select(F.col("library_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    joined = lookup_join(roots, targets, "id", "left")
    stamp = as_timestamp(now)
    for name in ("last_scanned_at", "updated_at"):
        joined = joined.withColumn(name, F.when(F.col("_hit"), stamp).otherwise(F.col(name)))
    return joined.select(*LIBRARY_ROOTS.fieldNames())
