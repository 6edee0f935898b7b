"""End-to-end jobs over a snapshot store: scan, hash, request variants."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from samebytes.functions.common import as_timestamp
from samebytes.functions.predicates import Clock
from samebytes.operators.duplicates import (
    apply_changes,
    content_totals,
    groups_of_totals,
    ranked_groups,
    total_changes,
)
from samebytes.operators.hashing import apply_outcomes, hash_summary, next_hash_files, with_root
from samebytes.operators.merge import (
    assign_ids,
    merge_scan,
    register_roots,
    stamp_scanned_roots,
)
from samebytes.operators.scale import lookup_join, materialize
from samebytes.operators.stats import error_digest, scan_summary, scan_targets
from samebytes.operators.variants import admit, apply_requests, match_variants, plan_requests
from samebytes.schemas import LIBRARIES_ROOT, SCAN_SESSIONS, VARIANT_CAPACITY
from samebytes.sources.content import hash_files
from samebytes.sources.filetree import library_names, walk_tree
from samebytes.sources.store import SnapshotStore


def run_scan(
    store: SnapshotStore,
    libraries_root: str,
    now: Clock,
    libraries: list[str] | None = None,
) -> Row:
    """Walk the libraries, merge what was found and record the session, which is returned.

    Files found are kept even if some entries failed, but then nothing is marked missing.
    """
    spark = store.spark
    names = library_names(libraries_root) if libraries is None else libraries
    asked = spark.createDataFrame([(name,) for name in names], "name string")
    targets = materialize(scan_targets(asked))
    if targets.count() != len({name.strip() for name in names}):
        raise ValueError("a library name is not valid")

    base = F.lit(libraries_root.rstrip("/") + "/")
    found = targets.select("name", F.concat(base, "name").alias("root_path"))
    roots = materialize(register_roots(store.read("library_roots"), found, now))
    entries = walk_tree(spark, libraries_root, [row.name for row in targets.collect()])

    total = scan_summary(entries).filter(F.col("library").isNull()).first()
    message = error_digest(entries).first().error_message if total.error_count else None
    sessions = store.read("scan_sessions")
    scan_id = sessions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1

    scanned = roots.join(targets, "name", "left_semi").select(F.col("id").alias("library_id"))
    ids = roots.select(F.col("id").alias("library_id"), F.col("name").alias("library"))
    files = lookup_join(entries.filter(F.col("kind") == "file"), ids, "library")
    catalog = store.read("library_files")
    merged = merge_scan(
        catalog, files, scanned,
        scan_id=scan_id, now=now, complete=total.error_count == 0,
        new_ids=assign_ids(catalog, files),
    )
    store.publish("library_files", merged.drop("change"))
    if total.error_count == 0:
        roots = stamp_scanned_roots(roots, scanned, now)
    store.publish("library_roots", roots)

    session = spark.range(1).select(
        F.lit(scan_id).cast("bigint").alias("id"),
        F.lit(total.status).alias("status"),
        as_timestamp(now).alias("started_at"),
        as_timestamp(now).alias("finished_at"),
        F.lit(message).cast("string").alias("error_message"),
        *[F.lit(total[c]).cast(SCAN_SESSIONS[c].dataType).alias(c)
          for c in ("files_seen", "directories_seen", "bytes_seen", "error_count")],
    )
    store.publish("scan_sessions", sessions.unionByName(session))
    return store.read("scan_sessions").filter(F.col("id") == scan_id).first()


def run_hash(
    store: SnapshotStore,
    now: Clock,
    max_files: int | None = None,
    algorithm: str = "sha256",
    libraries_root: str | None = LIBRARIES_ROOT,
) -> Row:
    """Hash due files (all of them, or the first `max_files` by id) and return the counts.

    Only the buckets of the catalog that hold these files are written anew.

    Libraries outside `libraries_root` are not read, and their files fail; None lifts that.
    """
    catalog = store.read("library_files")
    due = next_hash_files(catalog, now, max_files)
    candidates = with_root(due, store.read("library_roots"))
    # Reading files is the expensive part and must happen once.
    outcomes = materialize(hash_files(candidates, algorithm=algorithm, libraries_root=libraries_root))
    touched = store.touched("library_files", due)
    updated = apply_outcomes(
        store.read("library_files", buckets=touched), outcomes, algorithm=algorithm, now=now
    )
    store.replace("library_files", updated, touched, cluster_by=["hash_algorithm", "content_hash", "id"])
    return hash_summary(outcomes).first()


def refresh_totals(store: SnapshotStore) -> DataFrame:
    """The totals of all contents, brought up to the current catalog.

    Buckets of the catalog that were written since the last refresh are compared with what they
    were, and only the totals of contents that changed there are worked out and written. The first
    time, after a whole scan, or when the older version is no longer kept, all are.

    The catalog version that totals belong to is written last. What a crash before that has left in
    some buckets is not built upon: those are worked out again from the version before.
    """
    spark, current = store.spark, store.current_version("library_files")
    known = store.current_version("totals_version") > 0
    since, base = store.read("totals_version").first() if known else (0, 0)
    if known and since == current:
        return store.read("content_totals", base)
    changed = store.changed("library_files", since) if known else None
    left_over = store.changed("content_totals", base) if changed else []
    if changed and left_over is not None:
        try:
            before = store.read("library_files", since, changed)
            store.read("content_totals", base)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            changed = None
    elif changed:
        changed = None
    if changed is None:
        store.publish("content_totals", content_totals(store.read("library_files")))
    elif changed:
        after = store.read("library_files", current, changed)
        changes = materialize(total_changes(before, after))
        touched = sorted({*store.touched("content_totals", changes), *left_over})
        part = store.read("content_totals", base, touched)
        catalog = store.read("library_files", current)
        store.replace("content_totals", apply_changes(part, changes, catalog), touched)
    base = store.current_version("content_totals")
    store.publish("totals_version", spark.createDataFrame([(current, base)], "version long, totals long"))
    return store.read("content_totals", base)


def publish_groups(store: SnapshotStore) -> DataFrame:
    """Find duplicate groups once and keep them for paging, with their rank, in its order.

    `duplicates.GroupListing` reads pages of them as ranges of ranks.
    """
    groups = groups_of_totals(refresh_totals(store))
    store.publish("duplicate_groups", ranked_groups(groups), cluster_by=["rank"], partition_by=["rank_block"])
    return store.read("duplicate_groups")


def run_requests(
    store: SnapshotStore,
    requests: DataFrame,
    now: Clock,
    *,
    capacity: int = VARIANT_CAPACITY,
    libraries_root: str = LIBRARIES_ROOT,
) -> DataFrame:
    """Work off a batch of variant requests; yields rejects and outcomes per distinct request."""
    variants = store.read("thumbnails")
    planned = materialize(
        plan_requests(
            requests, store.read("library_files"), store.read("library_roots"),
            libraries_root=libraries_root,
        )
    )
    decided = materialize(admit(match_variants(planned, variants, now), variants, capacity))
    changed = decided.filter(F.col("outcome").isin("admitted", "requeued"))
    touched = store.touched("thumbnails", changed)
    after = apply_requests(
        store.read("thumbnails", buckets=touched), decided, now, largest=store.top_id("thumbnails")
    )
    store.replace("thumbnails", after, touched)
    rejected = planned.filter(F.col("reject").isNotNull())
    return decided.unionByName(rejected.withColumn("outcome", F.lit("rejected")))
