"""Sources, catalog merge, hashing, duplicate groups and statistics (S, J, A, T, W, D, M)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from checks.registry import ORACLES, check
from checks.views import NOW, with_views
from samebytes import schemas as S
from samebytes.operators import conform, duplicates, hashing, merge, stats
from samebytes.operators.scale import materialize, shared_folder
from samebytes.sources import content, filetree
from samebytes.sources.store import SnapshotStore

_NOW = f"TIMESTAMP '{NOW}'"
_NOW_US = 1_705_363_200_000_000
_ELIGIBLE = (
    "NOT is_missing AND NOT needs_hash AND hash_algorithm IS NOT NULL "
    "AND content_hash_hex IS NOT NULL"
)
GROUPS = f""", grouped AS (SELECT hash_algorithm || ':' || content_hash_hex AS group_key, hash_algorithm, content_hash_hex,
 count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
 CAST(sum(size_bytes) - min(size_bytes) AS BIGINT) AS duplicate_waste_bytes, min(id) AS sample_file_id
 FROM files WHERE {_ELIGIBLE} GROUP BY hash_algorithm, content_hash_hex HAVING count(*) > 1)
"""
_ORDER = "file_count DESC, total_size_bytes DESC, hash_algorithm, content_hash_hex"


def flat(catalog, *more):
    """All columns of a catalog as numbers and text, which both engines write alike."""
    kinds = {
        "timestamp": lambda c: F.unix_micros(c),
        "binary": lambda c: F.lower(F.hex(c)),
        "integer": lambda c: F.col(c).cast("bigint"),
    }
    columns = [kinds.get(f.dataType.typeName(), F.col)(f.name).alias(f.name) for f in S.LIBRARY_FILES]
    return catalog.select(*columns, *more)


def flat_sql(**changed: str) -> str:
    """The same of the `catalog` view, with other expressions for some columns."""
    parts = []
    for f in S.LIBRARY_FILES:
        value = changed.get(f.name, "content_hash_hex" if f.name == "content_hash" else f.name)
        kind = f.dataType.typeName()
        value = f"epoch_us({value})" if kind == "timestamp" else f"CAST({value} AS BIGINT)" if kind == "integer" else value
        parts.append(f"{value} AS {f.name}")
    return ", ".join(parts)


# --- sources: the documents as files ------------------------------------------
def document_tree(t) -> str:
    """Every document as a file `lib-<source>/<lang>/<doc_id>.txt` in the shared folder.

    The tree is written by tasks, once per session and scale.
    """
    folder = shared_folder(t.spark).removeprefix("file:")
    root = os.path.join(folder, f"tree-{uuid.uuid5(uuid.NAMESPACE_URL, t.folder).hex}")
    if os.path.exists(f"{root}.done"):
        return root
    os.makedirs(root, exist_ok=True)

    def write(rows):
        for row in rows:
            target = os.path.join(root, f"lib-{row.source}", row.lang)
            os.makedirs(target, exist_ok=True)
            with open(os.path.join(target, f"{row.doc_id}.txt"), "wb") as file:
                file.write(row.text.encode("utf-8"))

    t.documents.repartition(8).foreachPartition(write)
    open(f"{root}.done", "w").close()
    return root


@check(
    "s1_library_discovery",
    "SELECT DISTINCT 'lib-' || source AS library FROM documents",
)
def _(t):
    entries = filetree.read_tree(t.spark, document_tree(t))
    return entries.filter((F.col("kind") == "directory") & (F.col("relative_path") == "")).select(
        "library"
    )


_TREE_SQL = """SELECT 'lib-' || source AS library, 'file' AS kind, lang || '/' || doc_id || '.txt' AS relative_path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents
 UNION ALL SELECT DISTINCT 'lib-' || source, 'directory', lang, CAST(NULL AS BIGINT) FROM documents
 UNION ALL SELECT DISTINCT 'lib-' || source, 'directory', '', CAST(NULL AS BIGINT) FROM documents"""


@check("s2_file_tree_scan", _TREE_SQL)
def _(t):
    entries = filetree.read_tree(t.spark, document_tree(t))
    return entries.select("library", "kind", "relative_path", "size_bytes")


@check("s2_file_tree_walk", _TREE_SQL)
def _(t):
    entries = filetree.walk_tree(t.spark, document_tree(t), budget=200)
    return entries.select("library", "kind", "relative_path", "size_bytes")


def deep_tree(t) -> str:
    """A library per source that holds a path too long to be opened, in the shared folder."""
    root = os.path.join(shared_folder(t.spark).removeprefix("file:"), f"deep-{uuid.uuid4().hex}")
    for row in t.documents.select("source").distinct().toLocalIterator():
        os.makedirs(os.path.join(root, f"lib-{row.source}"))
        here = os.open(os.path.join(root, f"lib-{row.source}"), os.O_RDONLY)
        for _ in range(21):
            os.mkdir("d" * 200, dir_fd=here)
            below = os.open("d" * 200, os.O_RDONLY, dir_fd=here)
            os.close(here)
            here = below
        os.close(here)
    return root


@check(
    "s3_scan_errors",
    """SELECT DISTINCT 'lib-' || source || '-gone' AS library, 'No such file or directory' AS error FROM documents
 UNION ALL SELECT DISTINCT 'lib-' || source, 'File name too long' FROM documents""",
)
def _(t):
    # Libraries that are asked for but absent, and entries that cannot be read.
    root = deep_tree(t)
    names = [f"lib-{r.source}" for r in t.documents.select("source").distinct().collect()]
    entries = filetree.walk_tree(t.spark, root, [*names, *[f"{name}-gone" for name in names]])
    return entries.filter(F.col("kind") == "error").select("library", "error")


@check(
    "s4_snapshot_store",
    f"SELECT {flat_sql(size_bytes='size_bytes + CASE WHEN id % 97 = 3 THEN 1 ELSE 0 END')} FROM catalog",
    "catalog",
)
def _(t):
    store = SnapshotStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    store.publish("library_files", t.catalog, cluster_by=["hash_algorithm", "content_hash", "id"])
    # Some files change, and only their buckets are written again.
    touched = store.touched("library_files", t.catalog.filter("id % 97 = 3"))
    part = store.read("library_files", buckets=touched)
    grown = part.withColumn("size_bytes", F.expr("size_bytes + if(id % 97 = 3, 1, 0)"))
    store.replace("library_files", grown, touched, cluster_by=["hash_algorithm", "content_hash", "id"])
    return flat(store.read("library_files"))


@check(
    "s5_content_hash",
    """SELECT doc_id + 1 AS id, 'hashed' AS outcome, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes_hashed, NULL AS error FROM documents
 UNION ALL SELECT -doc_id - 1, 'failed', NULL, 0, 'library lies outside the libraries root' FROM documents WHERE doc_id % 50 = 3
 UNION ALL SELECT -doc_id - 1, 'failed', NULL, 0, 'candidate path escapes its library' FROM documents WHERE doc_id % 50 = 4""",
)
def _(t):
    root = document_tree(t)
    files = materialize(filetree.read_tree(t.spark, root).filter(F.col("kind") == "file"))
    number = F.regexp_extract("relative_path", r"(\d+)\.txt$", 1).cast("bigint")
    candidates = files.select(
        (number + 1).alias("id"), "relative_path", F.col("size_bytes").alias("expected_size"),
        F.col("mtime_ns").alias("expected_mtime_ns"), F.concat(F.lit(f"{root}/"), "library").alias("root_path"),
    )
    # Some files are asked for in a library beside the root, and some by a path out of their library.
    outside = f"{root}-outside"
    os.makedirs(outside, exist_ok=True)
    strays = candidates.withColumns({"id": -F.col("id"), "root_path": F.lit(outside)}).filter("(-id - 1) % 50 = 3")
    escapes = candidates.withColumns(
        {"id": -F.col("id"), "relative_path": F.concat(F.lit("../../x/"), "relative_path")}
    ).filter("(-id - 1) % 50 = 4")
    asked = candidates.unionByName(strays).unionByName(escapes)
    return content.hash_files(asked, libraries_root=root).select(
        "id", "outcome", F.lower(F.hex("digest")).alias("digest"), "bytes_hashed", "error"
    )


@check(
    "s6_register_roots",
    """, found AS (SELECT DISTINCT 'lib-' || lang AS name, '/libraries/lib-' || lang AS root_path FROM documents
  UNION ALL SELECT name, '/moved/' || name FROM roots)
 SELECT coalesce(r.id, (SELECT max(id) FROM roots) + row_number() OVER (PARTITION BY r.id IS NULL ORDER BY f.name)) AS id, f.name, f.root_path
 FROM found f LEFT JOIN roots r ON r.name = f.name""",
    "roots",
)
def _(t):
    roots = conform.conform(t.roots, "library_roots", NOW)
    new = t.documents.selectExpr("concat('lib-', lang) AS name", "concat('/libraries/lib-', lang) AS root_path")
    found = new.distinct().unionByName(t.roots.selectExpr("name", "concat('/moved/', name) AS root_path"))
    return merge.register_roots(roots, found, NOW).select("id", "name", "root_path")


# --- merge ---------------------------------------------------------------------
_MERGE = f""", joined AS (SELECT f.*, s.library_id AS n_library, s.relative_path AS n_path, s.size_bytes AS n_size, s.mtime_ns AS n_mtime, s.inode AS n_inode, s.device AS n_device,
 CASE WHEN f.id IS NULL THEN 'added' WHEN s.library_id IS NULL THEN CASE WHEN f.library_id IN (SELECT library_id FROM scanned) AND NOT f.is_missing THEN 'missing' ELSE 'untouched' END
  WHEN f.is_missing THEN 'reappeared' WHEN f.size_bytes <> s.size_bytes OR f.mtime_ns <> s.mtime_ns OR coalesce(f.inode, -1) <> coalesce(s.inode, -1) OR coalesce(f.device, -1) <> coalesce(s.device, -1) THEN 'changed'
  ELSE 'unchanged' END AS change
 FROM catalog f FULL OUTER JOIN scan s ON s.library_id = f.library_id AND s.relative_path = f.relative_path)
"""
_STALE = "change IN ('added', 'changed', 'reappeared')"


def merged_sql(new_id: str) -> str:
    """All columns of the catalog after a merge, from `joined`."""
    changed = {
        "id": f"coalesce(id, {new_id})", "library_id": "coalesce(n_library, library_id)",
        "relative_path": "coalesce(n_path, relative_path)", "size_bytes": "coalesce(n_size, size_bytes)",
        "mtime_ns": "coalesce(n_mtime, mtime_ns)",
        "inode": "CASE WHEN n_library IS NULL THEN inode ELSE n_inode END",
        "device": "CASE WHEN n_library IS NULL THEN device ELSE n_device END",
        "is_missing": "CASE WHEN n_library IS NOT NULL THEN false WHEN change = 'missing' THEN true ELSE is_missing END",
        "needs_hash": f"CASE WHEN {_STALE} THEN true WHEN change = 'missing' THEN false ELSE needs_hash END",
        "last_seen_scan_id": "CASE WHEN n_library IS NULL THEN last_seen_scan_id ELSE 77 END",
        "created_at": f"CASE WHEN change = 'added' THEN {_NOW} ELSE created_at END",
        "updated_at": f"CASE WHEN change = 'untouched' THEN updated_at ELSE {_NOW} END",
        "hash_error_count": f"CASE WHEN {_STALE} THEN 0 ELSE hash_error_count END",
        "content_hash": f"CASE WHEN NOT {_STALE} THEN content_hash_hex END",
    }
    for name in ("hash_algorithm", "hashed_size_bytes", "hashed_mtime_ns", "hashed_at", "hash_last_error", "hash_last_error_at"):
        changed[name] = f"CASE WHEN NOT {_STALE} THEN {name} END"
    for name in ("hash_retry_after", "hash_claim_token", "hash_claimed_at"):
        changed[name] = f"CASE WHEN NOT {_STALE} AND change <> 'missing' THEN {name} END"
    return flat_sql(**changed)


@check(
    "j1_catalog_merge",
    _MERGE + "SELECT "
    + merged_sql("(SELECT max(id) FROM files) + row_number() OVER (PARTITION BY id IS NULL ORDER BY n_library, n_path)")
    + ", change FROM joined",
    "files catalog scan scanned",
)
def _(t):
    scan = materialize(t.scan)
    ids = merge.assign_ids(t.catalog, scan)
    return flat(merge.merge_scan(t.catalog, scan, t.scanned, scan_id=77, now=NOW, new_ids=ids), "change")


@check("j2_mark_missing", _MERGE + "SELECT id FROM joined WHERE change = 'missing'", "catalog scan scanned")
def _(t):
    return merge.missing_files(t.files, t.scan, t.scanned).select("id")


@check(
    "d1_scan_diff",
    _MERGE + "SELECT coalesce(n_library, library_id) AS library_id, coalesce(n_path, relative_path) AS relative_path, change FROM joined",
    "catalog scan scanned",
)
def _(t):
    changes = merge.scan_changes(t.files, t.scan, t.scanned)
    return changes.select("library_id", "relative_path", "change")


@check(
    "w8_assign_ids",
    """SELECT s.library_id, s.relative_path, (SELECT max(id) FROM files) + row_number() OVER (ORDER BY s.library_id, s.relative_path) AS id
 FROM scan s LEFT JOIN files f ON s.library_id = f.library_id AND s.relative_path = f.relative_path WHERE f.id IS NULL""",
    "files scan",
)
def _(t):
    return merge.assign_ids(t.files, t.scan)


# --- hashing ---------------------------------------------------------------------
_CANDIDATE = f"""needs_hash AND NOT is_missing AND (hash_retry_after IS NULL OR hash_retry_after <= {_NOW})
 AND (hash_claim_token IS NULL OR hash_claimed_at IS NULL OR hash_claimed_at <= {_NOW} - INTERVAL 600 SECOND)"""


@check(
    "t4_next_hash_files",
    f"SELECT id FROM files WHERE {_CANDIDATE} ORDER BY id LIMIT 512",
    "files",
)
def _(t):
    return hashing.next_hash_files(t.files, NOW, S.HASH_FETCH_BATCH).select("id")


@check(
    "j4_candidates_with_root",
    f"""SELECT f.id, relative_path, size_bytes AS expected_size, mtime_ns AS expected_mtime_ns, hash_error_count, root_path
 FROM files f JOIN roots r ON r.id = f.library_id WHERE {_CANDIDATE}""",
    "files roots",
)
def _(t):
    return hashing.with_root(hashing.next_hash_files(t.files, NOW), t.roots)


_DONE = "o.outcome IN ('hashed', 'requeued')"
_OUTCOME = {
    **{c: f"CASE WHEN o.outcome = 'requeued' THEN o.{c} ELSE f.{c} END" for c in ("size_bytes", "mtime_ns", "inode", "device")},
    "id": "f.id",
    "is_missing": f"CASE WHEN o.outcome = 'missing' THEN true WHEN {_DONE} THEN false ELSE is_missing END",
    "needs_hash": "CASE WHEN o.outcome IN ('hashed', 'missing') THEN false WHEN o.outcome IN ('requeued', 'failed') THEN true ELSE needs_hash END",
    "hash_algorithm": "CASE o.outcome WHEN 'hashed' THEN 'sha256' WHEN 'requeued' THEN NULL ELSE hash_algorithm END",
    "content_hash": "CASE o.outcome WHEN 'hashed' THEN digest_hex WHEN 'requeued' THEN NULL ELSE content_hash_hex END",
    "hashed_size_bytes": "CASE o.outcome WHEN 'hashed' THEN o.size_bytes WHEN 'requeued' THEN NULL ELSE hashed_size_bytes END",
    "hashed_mtime_ns": "CASE o.outcome WHEN 'hashed' THEN o.mtime_ns WHEN 'requeued' THEN NULL ELSE hashed_mtime_ns END",
    "hashed_at": f"CASE o.outcome WHEN 'hashed' THEN {_NOW} WHEN 'requeued' THEN NULL ELSE hashed_at END",
    "hash_error_count": f"CASE WHEN {_DONE} THEN 0 WHEN o.outcome = 'failed' THEN hash_error_count + 1 ELSE hash_error_count END",
    "hash_last_error": f"CASE WHEN {_DONE} THEN NULL WHEN o.outcome = 'failed' THEN o.error ELSE hash_last_error END",
    "hash_last_error_at": f"CASE WHEN {_DONE} THEN NULL WHEN o.outcome = 'failed' THEN {_NOW} ELSE hash_last_error_at END",
    "hash_retry_after": f"CASE WHEN {_DONE} OR o.outcome = 'missing' THEN NULL WHEN o.outcome = 'failed' THEN {_NOW} + least(30 * CAST(2 ** hash_error_count AS BIGINT), 3600) * INTERVAL '1' SECOND ELSE hash_retry_after END",
    "hash_claim_token": "CASE WHEN o.outcome IS NULL THEN hash_claim_token END",
    "hash_claimed_at": "CASE WHEN o.outcome IS NULL THEN hash_claimed_at END",
    "updated_at": f"CASE WHEN o.outcome IS NULL THEN updated_at ELSE {_NOW} END",
}


@check(
    "j9_apply_outcomes",
    f"SELECT {flat_sql(**_OUTCOME)} FROM catalog f LEFT JOIN outcomes o ON o.id = f.id",
    "catalog outcomes",
)
def _(t):
    return flat(hashing.apply_outcomes(t.catalog, t.outcomes, algorithm="sha256", now=NOW))


@check(
    "a4_hash_summary",
    """SELECT count(*) AS processed, count(*) FILTER (outcome = 'hashed') AS hashed, count(*) FILTER (outcome = 'requeued') AS requeued,
 count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'failed') AS failed,
 CAST(coalesce(sum(bytes_hashed) FILTER (outcome = 'hashed'), 0) AS BIGINT) AS bytes_hashed FROM outcomes""",
    "outcomes",
)
def _(t):
    return hashing.hash_summary(t.outcomes)


# --- duplicate groups --------------------------------------------------------------
@check("a1_duplicate_groups", GROUPS + "SELECT * FROM grouped", "files")
def _(t):
    return duplicates.duplicate_groups(t.files).drop("content_hash")


@check(
    "a2_duplicate_totals",
    GROUPS
    + "SELECT count(*) AS group_count, CAST(coalesce(sum(file_count), 0) AS BIGINT) AS file_count, CAST(coalesce(sum(duplicate_waste_bytes), 0) AS BIGINT) AS duplicate_waste_bytes FROM grouped",
    "files",
)
def _(t):
    return duplicates.duplicate_totals(duplicates.duplicate_groups(t.files))


@check(
    "j3_group_members",
    GROUPS
    + f"""SELECT g.group_key, f.id AS file_id, f.library_id, r.name AS library_name, f.relative_path, f.size_bytes, f.mtime_ns
 FROM files f JOIN grouped g ON g.hash_algorithm = f.hash_algorithm AND g.content_hash_hex = f.content_hash_hex
 JOIN roots r ON r.id = f.library_id WHERE NOT is_missing AND NOT needs_hash""",
    "files roots",
)
def _(t):
    catalog = conform.conform(t.files, "library_files")
    groups = duplicates.duplicate_groups(catalog)
    # Groups of three files already take the way of hot groups, so both ways are checked.
    return duplicates.group_members(catalog, t.roots, groups, hot_files=3).drop("hashed_at")


@check(
    "j3_group_members_cold",
    ORACLES["j3_group_members"].removeprefix(with_views(("files", "roots"))),
    "files roots",
)
def _(t):
    # No group is that large, so all join by shuffle.
    catalog = conform.conform(t.files, "library_files")
    return duplicates.group_members(catalog, t.roots, duplicates.duplicate_groups(catalog)).drop("hashed_at")


@check(
    "t1_group_page",
    GROUPS + f"SELECT * FROM grouped ORDER BY {_ORDER} LIMIT 15 OFFSET 15",
    "files",
)
def _(t):
    groups = materialize(duplicates.duplicate_groups(t.files))
    first = duplicates.group_page(groups, 15).collect()
    return duplicates.group_page(groups, 15, first[-1].cursor).drop("content_hash", "cursor")


@check(
    "t1_ranked_listing",
    GROUPS + f"SELECT * FROM grouped ORDER BY {_ORDER} LIMIT 15 OFFSET 15",
    "files",
)
def _(t):
    store = SnapshotStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    groups = duplicates.duplicate_groups(t.files)
    store.publish("duplicate_groups", duplicates.ranked_groups(groups), cluster_by=["rank"], partition_by=["rank_block"])
    ranked = store.read("duplicate_groups")
    first = duplicates.GroupListing(ranked).page(15)
    # Another listing does not know the cursor and has to place it.
    page = duplicates.GroupListing(ranked).page(15, first.next_cursor) if first.next_cursor else duplicates.Page([], None)
    columns = [c for c in ranked.columns if c not in ("rank", "rank_block", "content_hash")]
    return t.spark.createDataFrame(page.items, ranked.select(*columns).schema)


@check(
    "t2_group_file_page",
    GROUPS
    + f"""SELECT f.id AS file_id, f.library_id, r.name AS library_name, f.relative_path, f.size_bytes, f.mtime_ns
 FROM files f JOIN roots r ON r.id = f.library_id
 JOIN (SELECT * FROM grouped ORDER BY {_ORDER} LIMIT 1) g ON g.group_key = f.hash_algorithm || ':' || f.content_hash_hex
 WHERE NOT is_missing AND NOT needs_hash AND f.id > g.sample_file_id ORDER BY f.id LIMIT 10""",
    "files roots",
)
def _(t):
    catalog = conform.conform(t.files, "library_files")
    top = duplicates.list_groups(duplicates.duplicate_groups(catalog), 1).items[0]
    page = duplicates.group_file_page(catalog, t.roots, top.group_key, 10, str(top.sample_file_id))
    return page.drop("hashed_at")


@check(
    "w7_page_numbers",
    GROUPS
    + f"""SELECT group_key, row_number() OVER (ORDER BY {_ORDER}) - 1 AS rank, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 10 AS page FROM grouped""",
    "files",
)
def _(t):
    groups = duplicates.duplicate_groups(t.files)
    return duplicates.numbered_pages(groups, 10).select("group_key", "rank", "page")


# --- statistics ----------------------------------------------------------------------
@check(
    "a3_scan_summary",
    """SELECT library, files_seen, directories_seen, bytes_seen, error_count, CASE WHEN error_count = 0 THEN 'succeeded' ELSE 'failed' END AS status
 FROM (SELECT library, count(*) FILTER (kind = 'file') AS files_seen, count(*) FILTER (kind = 'directory') AS directories_seen,
  CAST(coalesce(sum(size_bytes) FILTER (kind = 'file'), 0) AS BIGINT) AS bytes_seen, count(*) FILTER (kind = 'error') AS error_count
  FROM entries GROUP BY ROLLUP (library))""",
    "entries",
)
def _(t):
    return stats.scan_summary(t.entries)


@check(
    "a9_error_digest",
    """SELECT (SELECT count(*) FROM entries WHERE kind = 'error') AS error_count, 'Scan encountered ' || (SELECT count(*) FROM entries WHERE kind = 'error') || ' filesystem access errors: ' || string_agg('/libraries/' || library || '/' || relative_path || ': ' || error, ' | ' ORDER BY library, relative_path) AS error_message
 FROM (SELECT * FROM entries WHERE kind = 'error' ORDER BY library, relative_path LIMIT 20)""",
    "entries",
)
def _(t):
    return stats.error_digest(t.entries)


_STATS = """, n AS (SELECT count(*) AS requests, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'queue_full') AS queue_full,
 count(*) FILTER (status = 'failed') AS failed, count(DISTINCT thumb_key) FILTER (status = 'accepted') AS unique_thumb_keys FROM log),
 r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS pos FROM log),
 s AS (SELECT n.*, requests / 60.0::DOUBLE AS throughput_rps, queue_full / requests AS queue_full_ratio, failed / requests AS failed_ratio, 1 - unique_thumb_keys / accepted AS dedupe_ratio,
 (SELECT latency_ms FROM r WHERE pos = CAST(round_even((n.requests - 1) * 0.5::DOUBLE, 0) AS BIGINT)) AS latency_p50_ms,
 (SELECT latency_ms FROM r WHERE pos = CAST(round_even((n.requests - 1) * 0.95::DOUBLE, 0) AS BIGINT)) AS latency_p95_ms FROM n)
"""


@check("a10_request_statistics", _STATS + "SELECT * FROM s", "log")
def _(t):
    return stats.request_statistics(t.log, 60.0)


@check(
    "a11_threshold_failures",
    _STATS
    + """SELECT * FROM (SELECT 'throughput_rps' AS metric, throughput_rps AS value, 250.0::DOUBLE AS "limit", 'min' AS side FROM s UNION ALL
 SELECT 'dedupe_ratio', dedupe_ratio, 0.85::DOUBLE, 'min' FROM s UNION ALL SELECT 'queue_full_ratio', queue_full_ratio, 0.01::DOUBLE, 'max' FROM s
 UNION ALL SELECT 'failed_ratio', failed_ratio, 0.001::DOUBLE, 'max' FROM s) WHERE CASE side WHEN 'min' THEN value < "limit" ELSE value > "limit" END""",
    "log",
)
def _(t):
    measured = stats.request_statistics(t.log, 60.0)
    return stats.threshold_failures(
        measured,
        at_least={"throughput_rps": 250.0, "dedupe_ratio": 0.85},
        at_most={"queue_full_ratio": 0.01, "failed_ratio": 0.001},
    )


@check(
    "t6_top_errors",
    "SELECT error, count(*) AS occurrences FROM log WHERE error IS NOT NULL GROUP BY error ORDER BY occurrences DESC, error LIMIT 5",
    "log",
)
def _(t):
    return stats.top_errors(t.log)


@check(
    "t7_scan_targets",
    """SELECT DISTINCT trim(name) AS name FROM (SELECT '  ' || source || ' ' AS name FROM documents UNION ALL SELECT path FROM paths UNION ALL SELECT lang FROM documents)
 WHERE NOT contains(name, '/') AND NOT contains(name, '~') AND NOT contains(name, '$')""",
    "paths",
)
def _(t):
    names = (
        t.documents.selectExpr("concat('  ', source, ' ') AS name")
        .union(t.paths.select("path"))
        .union(t.documents.select("lang"))
    )
    return stats.scan_targets(names)


@check(
    "a12_duplicate_keys",
    "SELECT library_id, source_name, count(*) AS row_count FROM (SELECT library_id, split_part(relative_path, '/', 1) AS source_name FROM files) GROUP BY ALL HAVING count(*) > 1",
    "files",
)
def _(t):
    # Top folders are far from unique per library.
    folders = t.files.select("library_id", F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("source_name"))
    return conform.duplicate_keys(folders, ["library_id", "source_name"])


@check(
    "a12_unique_keys",
    """SELECT table_name, key, sum(n)::BIGINT AS row_count FROM (
 SELECT 'library_files' AS table_name, library_id || ',' || relative_path AS key, count(*) AS n FROM (SELECT * FROM files UNION ALL SELECT * FROM files WHERE id % 50 = 1) GROUP BY ALL
 UNION ALL SELECT 'thumbnails', thumb_key, count(*) FROM (SELECT thumb_key FROM variants UNION ALL SELECT thumb_key FROM variants WHERE id % 70 = 0) GROUP BY ALL
 UNION ALL SELECT 'thumbnail_cleanup_jobs', group_key, count(*) FROM (SELECT group_key FROM cleanups UNION ALL SELECT group_key FROM cleanups WHERE id % 30 = 0) GROUP BY ALL)
 GROUP BY table_name, key HAVING sum(n) > 1""",
    "files variants cleanups",
)
def _(t):
    # Every stored table with a unique key, some of its rows doubled.
    doubled = {
        "library_files": t.files.unionByName(t.files.filter("id % 50 = 1")),
        "thumbnails": t.variants.unionByName(t.variants.filter("id % 70 = 0")),
        "thumbnail_cleanup_jobs": t.cleanups.unionByName(t.cleanups.filter("id % 30 = 0")),
    }
    found = [
        conform.duplicate_keys(doubled[name], key).select(F.lit(name).alias("table_name"), F.concat_ws(",", *key).alias("key"), "row_count")
        for name, key in ((name, S.UNIQUE_KEYS[name]) for name in doubled)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


_MAINTENANCE = "id, lower(requested_mode) AS requested_mode, lower(status) AS status"


@check("m2_lower_enums", f"SELECT {_MAINTENANCE} FROM maintenance", "maintenance")
def _(t):
    lowered = conform.lower_enums(t.maintenance, S.ENUM_COLUMNS["wal_maintenance_jobs"])
    return lowered.select("id", "requested_mode", "status")


@check(
    "m3_backfill_times",
    f"""SELECT id, epoch_us(CASE WHEN status = 'retryable' THEN coalesce(retry_after, execute_after) ELSE retry_after END) AS retry_us,
 epoch_us(coalesce(created_at, {_NOW})) AS created_us, epoch_us(coalesce(updated_at, created_at, {_NOW})) AS updated_us FROM maintenance""",
    "maintenance",
)
def _(t):
    filled = conform.backfill_times(t.maintenance, NOW)
    return filled.select(
        "id",
        F.unix_micros("retry_after").alias("retry_us"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
    )
