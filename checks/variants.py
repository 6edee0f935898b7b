"""Derived variants: planning, admission, concurrency, cleanup and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import NOW
from samebytes import schemas as S
from samebytes.operators import conform, variants

_NOW = f"TIMESTAMP '{NOW}'"
_NOW_US = 1_705_363_200_000_000

# Requests of the log, the same ones over the whole catalog, and some that cannot be served.
_REQUESTS = """, wanted AS (SELECT seq, file_id, CAST(max_dimension AS BIGINT) AS max_dimension, output_format FROM requests
  UNION ALL SELECT id * 7, id, CASE WHEN id % 19 = 3 THEN 9999 ELSE 256 END, CASE WHEN id % 23 = 5 THEN 'png' ELSE 'jpeg' END FROM files
  UNION ALL SELECT -page_id - 1, 900000000 + page_id, 256, 'webp' FROM pages)"""


def _requests(t):
    log = t.requests.selectExpr("seq", "file_id", "CAST(max_dimension AS BIGINT) max_dimension", "output_format")
    every = t.files.selectExpr(
        "id * 7", "id", "CASE WHEN id % 19 = 3 THEN 9999L ELSE 256L END",
        "CASE WHEN id % 23 = 5 THEN 'png' ELSE 'jpeg' END",
    )
    unknown = t.pages.selectExpr("-page_id - 1", "900000000 + page_id", "256L", "'webp'")
    return log.union(every).union(unknown)


_PLAN = (
    _REQUESTS
    + """, d AS (SELECT file_id, CASE WHEN max_dimension BETWEEN 1 AND 256 THEN max_dimension END AS max_dimension,
  CASE WHEN output_format IN ('jpeg', 'webp') THEN output_format END AS format, min(seq) AS first_seq, count(*) AS requests FROM wanted GROUP BY 1, 2, 3),
 p AS (SELECT d.*, f.id, f.size_bytes, f.mtime_ns, f.hash_algorithm, f.content_hash_hex, CASE WHEN lower(relative_path) LIKE '%.mp4' THEN 'video' WHEN lower(relative_path) LIKE '%.jpg' OR lower(relative_path) LIKE '%.webp' THEN 'image' END AS kind,
  CASE WHEN format IS NULL THEN 'unsupported_format' WHEN max_dimension IS NULL THEN 'bad_dimension' WHEN f.id IS NULL THEN 'file_not_found' WHEN f.is_missing THEN 'file_missing'
   WHEN NOT (lower(relative_path) LIKE '%.mp4' OR lower(relative_path) LIKE '%.jpg' OR lower(relative_path) LIKE '%.webp') THEN 'unsupported_media' END AS reject
  FROM d LEFT JOIN files f ON f.id = d.file_id),
 plan AS (SELECT *, CASE WHEN reject IS NULL THEN sha256(file_id || ':' || CASE WHEN hash_algorithm IS NULL THEN 'meta:' || size_bytes || ':' || mtime_ns
   ELSE hash_algorithm || ':' || content_hash_hex END || ':' || max_dimension || ':' || format || ':thumb-v2') END AS thumb_key FROM p)"""
)


def _plan(t):
    return variants.plan_requests(_requests(t), t.files, t.roots)


@check(
    "j8_request_rejects",
    _PLAN + "SELECT file_id, max_dimension, format, first_seq, requests, reject, thumb_key, CASE WHEN reject IS NULL THEN kind END AS media_type, thumb_key[1:2] || '/' || thumb_key[3:4] || '/' || thumb_key || CASE format WHEN 'jpeg' THEN '.jpg' ELSE '.webp' END AS output_relpath FROM plan",
    "files requests",
)
def _(t):
    return _plan(t).select(
        "file_id", "max_dimension", "format", "first_seq", "requests", "reject", "thumb_key",
        "media_type", "output_relpath",
    )


_MATCH = (
    _PLAN
    + f""", matched AS (SELECT plan.*, CASE WHEN v.status IS NULL THEN 'new' WHEN v.status <> 'failed' THEN 'existing' WHEN v.retry_after IS NULL OR v.retry_after <= {_NOW} THEN 'requeued' ELSE 'blocked' END AS outcome
  FROM plan LEFT JOIN variants v ON v.thumb_key = plan.thumb_key WHERE reject IS NULL)"""
)


@check("j7_match_variants", _MATCH + "SELECT thumb_key, requests, outcome FROM matched", "files requests variants")
def _(t):
    matched = variants.match_variants(_plan(t), t.variants, NOW)
    return matched.select("thumb_key", "requests", "outcome")


_ADMIT = (
    _MATCH
    + """, ranked AS (SELECT *, count(*) FILTER (outcome IN ('new', 'requeued')) OVER (ORDER BY first_seq, thumb_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM matched),
 depth AS (SELECT count(*) FILTER (status IN ('pending', 'running')) AS active FROM variants),
 decided AS (SELECT * REPLACE (CASE WHEN outcome <> 'new' THEN outcome WHEN (SELECT active FROM depth) + taken < 500 THEN 'admitted' ELSE 'queue_full' END AS outcome) FROM ranked)"""
)


@check("w3_capacity_admission", _ADMIT + "SELECT thumb_key, first_seq, outcome FROM decided", "files requests variants")
def _(t):
    matched = variants.match_variants(_plan(t), t.variants, NOW)
    return variants.admit(matched, t.variants, 500).select("thumb_key", "first_seq", "outcome")


@check(
    "w3_default_capacity",
    _ADMIT.replace("taken < 500", f"taken < {S.VARIANT_CAPACITY}") + "SELECT thumb_key, first_seq, outcome FROM decided",
    "files requests variants",
)
def _(t):
    # Beyond the rows of a top-k, free slots are found over range slices.
    matched = variants.match_variants(_plan(t), t.variants, NOW)
    return variants.admit(matched, t.variants).select("thumb_key", "first_seq", "outcome")


@check(
    "w3_apply_requests",
    _ADMIT
    + f"""SELECT v.id, v.thumb_key, CASE WHEN d.outcome = 'requeued' THEN 'pending' ELSE v.status END AS status, CASE WHEN d.outcome = 'requeued' THEN NULL ELSE v.error_code END AS error_code,
  CASE WHEN d.outcome = 'requeued' THEN NULL ELSE epoch_us(v.retry_after) END AS retry_us FROM variants v LEFT JOIN decided d ON d.thumb_key = v.thumb_key
 UNION ALL SELECT (SELECT max(id) FROM variants) + row_number() OVER (ORDER BY first_seq, thumb_key), thumb_key, 'pending', NULL, NULL FROM decided WHERE outcome = 'admitted'""",
    "files requests variants",
)
def _(t):
    table = conform.conform(t.variants, "thumbnails")
    decided = variants.admit(variants.match_variants(_plan(t), table, NOW), table, 500)
    after = variants.apply_requests(table, decided, NOW)
    return after.select("id", "thumb_key", "status", "error_code", F.unix_micros("retry_after").alias("retry_us"))


@check(
    "j5_task_details",
    """SELECT v.id, v.thumb_key, v.file_id, f.relative_path, r.root_path, v.media_type, v.source_size_bytes, coalesce(v.output_relpath, '') AS output_relpath, v.error_count
 FROM variants v JOIN files f ON f.id = v.file_id JOIN roots r ON r.id = f.library_id""",
    "variants files roots",
)
def _(t):
    return variants.task_details(t.variants, t.files, t.roots).select(
        "id", "thumb_key", "file_id", "relative_path", "root_path", "media_type",
        "source_size_bytes", "output_relpath", "error_count",
    )


@check(
    "j6_ready_cleanups",
    f"""SELECT id, group_key FROM cleanups c WHERE status = 'pending' AND execute_after <= {_NOW}
 AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.group_key = c.group_key AND v.status IN ('pending', 'running'))""",
    "cleanups variants",
)
def _(t):
    return variants.ready_cleanups(t.cleanups, t.variants, NOW).select("id", "group_key")


@check(
    "j10_drop_orphans",
    """, r AS (SELECT * FROM roots WHERE name <> 'lib-0' AND name <> 'lib-7'), s AS (SELECT DISTINCT user_id % 4 + 1 AS id FROM events),
 f AS (SELECT id, library_id, CASE WHEN last_seen_scan_id IN (SELECT id FROM s) THEN last_seen_scan_id END AS last_seen_scan_id FROM files WHERE library_id IN (SELECT id FROM r))
 SELECT id, 'file' AS what, last_seen_scan_id FROM f UNION ALL SELECT id, 'variant', NULL FROM variants WHERE file_id IN (SELECT id FROM f)""",
    "files roots variants",
)
def _(t):
    roots = t.roots.filter(~F.col("name").isin("lib-0", "lib-7"))
    sessions = t.events.selectExpr("user_id % 4 + 1 AS id").distinct()
    files, kept = variants.drop_orphans(roots, t.files, t.variants, sessions)
    left = files.select("id", F.lit("file").alias("what"), "last_seen_scan_id")
    none = F.lit(None).cast("bigint").alias("last_seen_scan_id")
    return left.unionByName(kept.select("id", F.lit("variant").alias("what"), none))


_SCHEDULE = """, asked AS (SELECT event_id AS seq, c.group_key, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -1 ELSE event_id % 90 END AS delay_seconds FROM events e JOIN cleanups c ON c.id = e.user_id * 3 + 1
  UNION ALL SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '  ' ELSE 'sha256:page-' || page_id // 3 END, page_id % 4 FROM pages)"""


@check(
    "j11_schedule_cleanups",
    _SCHEDULE
    + f""", valid AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY seq DESC) AS r FROM asked WHERE trim(group_key) <> '' AND coalesce(delay_seconds, 0) >= 0),
 last AS (SELECT group_key, coalesce(delay_seconds, 600) AS delay FROM valid WHERE r = 1)
 SELECT coalesce(c.id, (SELECT max(id) FROM cleanups) + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY l.group_key)) AS id, coalesce(c.group_key, l.group_key) AS group_key,
 CASE WHEN l.group_key IS NULL THEN c.status ELSE 'pending' END AS status, coalesce({_NOW_US} + delay * 1000000, epoch_us(c.execute_after)) AS execute_us,
 CASE WHEN l.group_key IS NULL THEN c.error_code END AS error_code FROM cleanups c FULL OUTER JOIN last l ON l.group_key = c.group_key""",
    "cleanups",
)
def _(t):
    log = t.events.join(t.cleanups, F.expr("id = user_id * 3 + 1")).selectExpr(
        "event_id AS seq", "group_key",
        "CAST(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -1 ELSE event_id % 90 END AS INT) AS delay_seconds",
    )
    new = t.pages.selectExpr(
        "page_id AS seq", "CASE WHEN page_id % 6 = 0 THEN '  ' ELSE concat('sha256:page-', page_id div 3) END AS group_key",
        "CAST(page_id % 4 AS INT) AS delay_seconds",
    )
    table = conform.conform(t.cleanups, "thumbnail_cleanup_jobs")
    after = variants.schedule_cleanups(table, log.unionByName(new), NOW)
    return after.select("id", "group_key", "status", F.unix_micros("execute_after").alias("execute_us"), "error_code")


@check(
    "j12_prunable_variants",
    f"""SELECT v.id, v.group_key, coalesce(v.output_relpath, '') AS output_relpath, v.output_relpath IS NOT NULL AS removable FROM variants v
 WHERE v.status IN ('ready', 'failed') AND v.group_key IN (SELECT group_key FROM cleanups WHERE status = 'pending' AND execute_after <= {_NOW})""",
    "variants cleanups",
)
def _(t):
    return variants.prunable_variants(t.variants, _due_groups(t))


def _due_groups(t):
    return t.cleanups.filter(f"status = 'pending' AND execute_after <= {_NOW}")


@check(
    "j12_prune_variants",
    f"""SELECT id, status FROM variants v WHERE NOT (status IN ('ready', 'failed') AND coalesce(group_key IN (SELECT group_key FROM cleanups WHERE status = 'pending' AND execute_after <= {_NOW}), false))""",
    "variants cleanups",
)
def _(t):
    return variants.prune_variants(t.variants, _due_groups(t)).select("id", "status")


@check(
    "a5_variant_metrics",
    f"""SELECT p + r AS queue_depth, p AS queue_pending, r AS queue_running, retry_backlog, retry_ready, cleanup_pending, cleanup_running, cleanup_overdue, cleanup_max_lag_seconds FROM
 (SELECT count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'running') AS r, count(*) FILTER (status = 'failed' AND retry_after > {_NOW}) AS retry_backlog,
  count(*) FILTER (status = 'failed' AND coalesce(retry_after, {_NOW}) <= {_NOW}) AS retry_ready FROM variants),
 (SELECT count(*) FILTER (status = 'pending') AS cleanup_pending, count(*) FILTER (status = 'running') AS cleanup_running, count(*) FILTER (status = 'pending' AND execute_after <= {_NOW}) AS cleanup_overdue,
  coalesce(({_NOW_US} - epoch_us(min(execute_after) FILTER (status = 'pending' AND execute_after <= {_NOW}))) // 1000000, 0) AS cleanup_max_lag_seconds FROM cleanups)""",
    "variants cleanups",
)
def _(t):
    return variants.variant_metrics(t.variants, t.cleanups, NOW)


@check("a7_active_depth", "SELECT count(*) FILTER (status IN ('pending', 'running')) AS active FROM variants", "variants")
def _(t):
    return variants.active_depth(t.variants)


@check(
    "a8_live_running",
    f"SELECT media_type, count(*) FILTER (status = 'running' AND lease_expires_at > {_NOW}) AS running FROM variants GROUP BY media_type",
    "variants",
)
def _(t):
    return variants.live_running(t.variants, NOW)


@check(
    "w5_concurrency_gate",
    f"""SELECT id, media_type FROM (SELECT v.id, v.media_type, row_number() OVER (PARTITION BY v.media_type ORDER BY created_at, id) AS r, a.running
 FROM variants v JOIN (SELECT media_type, count(*) FILTER (status = 'running' AND lease_expires_at > {_NOW}) AS running FROM variants GROUP BY 1) a ON a.media_type = v.media_type
 WHERE status = 'pending' AND (retry_after IS NULL OR retry_after <= {_NOW})) WHERE r <= CASE media_type WHEN 'image' THEN 90 WHEN 'video' THEN 60 END - running""",
    "variants",
)
def _(t):
    return variants.next_variants(t.variants, NOW, {"image": 90, "video": 60}).select("id", "media_type")
