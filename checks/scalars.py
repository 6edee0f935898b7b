"""Predicates and scalar functions (P and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import NOW
from samebytes import schemas as S
from samebytes.functions import common, cursors, hashes, numbers, paths, predicates, variants
from samebytes.operators.conform import conform
from samebytes.operators.queues import runnable_work

_NOW = f"TIMESTAMP '{NOW}'"
_ELIGIBLE = (
    "NOT is_missing AND NOT needs_hash AND hash_algorithm IS NOT NULL "
    "AND content_hash_hex IS NOT NULL"
)


@check("p1_dedup_eligible", f"SELECT id FROM files WHERE {_ELIGIBLE}", "files")
def _(t):
    return t.files.filter(predicates.dedup_eligible()).select("id")


@check(
    "p2_changed_file",
    """SELECT f.id, f.size_bytes <> s.size_bytes OR f.mtime_ns <> s.mtime_ns
 OR coalesce(f.inode, -1) <> coalesce(s.inode, -1) OR coalesce(f.device, -1) <> coalesce(s.device, -1)
 OR f.is_missing AS changed
 FROM files f JOIN scan s ON s.library_id = f.library_id AND s.relative_path = f.relative_path""",
    "files scan",
)
def _(t):
    both = t.files.alias("o").join(t.scan.alias("n"), ["library_id", "relative_path"])
    return both.select("id", predicates.metadata_changed("o.", "n.").alias("changed"))


@check(
    "p3_hash_candidates",
    f"""SELECT id FROM files WHERE needs_hash AND NOT is_missing
 AND (hash_retry_after IS NULL OR hash_retry_after <= {_NOW})
 AND (hash_claim_token IS NULL OR hash_claimed_at IS NULL OR hash_claimed_at <= {_NOW} - INTERVAL 600 SECOND)""",
    "files",
)
def _(t):
    return t.files.filter(predicates.hash_candidate(NOW)).select("id")


@check(
    "p4_stale_leases",
    f"""SELECT id, kind FROM jobs WHERE status = 'running' AND kind IN ('scan', 'hash')
 AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW})""",
    "jobs",
)
def _(t):
    return t.jobs.filter(predicates.stale_lease(NOW, ("scan", "hash"))).select("id", "kind")


@check(
    "p5_runnable_work",
    f"""SELECT 'jobs' AS queue, coalesce(max(kind IN ('scan', 'hash') AND (status = 'pending' OR (status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW})))), false) AS has_work FROM jobs
 UNION ALL SELECT 'variants', coalesce(max((status = 'pending' AND (retry_after IS NULL OR retry_after <= {_NOW})) OR (status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW}))), false) FROM variants
 UNION ALL SELECT 'cleanups', coalesce(max((status = 'pending' AND execute_after <= {_NOW}) OR (status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW}))), false) FROM cleanups
 UNION ALL SELECT 'maintenance', coalesce(max((status = 'pending' AND execute_after <= {_NOW}) OR (status = 'retryable' AND (retry_after IS NULL OR retry_after <= {_NOW})) OR (status = 'running' AND (lease_expires_at IS NULL OR lease_expires_at <= {_NOW}))), false) FROM maintenance""",
    "jobs variants cleanups maintenance",
)
def _(t):
    queues = {name: getattr(t, name) for name in ("jobs", "variants", "cleanups", "maintenance")}
    return runnable_work(queues, NOW)


@check(
    "p6_safe_relative_paths",
    r"""SELECT doc_id, path, reason IS NULL AS ok, reason FROM (SELECT doc_id, path,
 CASE WHEN path LIKE '/%' THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') THEN 'traversal'
 WHEN path LIKE '%~%' THEN 'home' WHEN path LIKE '%$%' THEN 'variable' END AS reason FROM paths)""",
    "paths",
)
def _(t):
    return t.paths.select("doc_id", "path", paths.safe_relative_path("path").alias("v")).select(
        "doc_id", "path", "v.ok", "v.reason"
    )


@check(
    "p7_contained_under_root",
    """, raw AS (SELECT doc_id, root, root || '/' || path AS candidate, string_split(root || '/' || path, '/') AS parts FROM paths),
 folded AS (SELECT doc_id, root, candidate, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda p: [p])),
   lambda done, part: CASE WHEN part[1] IN ('', '.') THEN done WHEN part[1] = '..' THEN done[:-2] ELSE list_concat(done, part) END) AS kept FROM raw)
 SELECT doc_id, candidate, normal, normal = root OR starts_with(normal, root || '/') AS contained
 FROM (SELECT doc_id, root, candidate, '/' || array_to_string(kept, '/') AS normal FROM folded)""",
    "paths",
)
def _(t):
    candidate = F.concat_ws("/", "root", "path")
    return t.paths.select(
        "doc_id",
        candidate.alias("candidate"),
        paths.normalize_lexically(candidate).alias("normal"),
        paths.contained_under("root", candidate).alias("contained"),
    )


@check(
    "p8_library_names",
    r"""SELECT doc_id, name, reason IS NULL AS ok, reason FROM (SELECT doc_id, trim(path) AS name,
 CASE WHEN trim(path) = '' THEN 'empty' WHEN trim(path) IN ('.', '..') THEN 'traversal'
 WHEN contains(path, '/') OR contains(path, '\') THEN 'nested' WHEN contains(path, '~') OR contains(path, '$') THEN 'expansion' END AS reason
 FROM (SELECT doc_id, path FROM paths UNION ALL SELECT doc_id, '  ' || source || ' ' FROM documents
   UNION ALL SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '..' WHEN 2 THEN source || '$' ELSE lang || '~1' END FROM documents))""",
    "paths",
)
def _(t):
    padded = t.documents.selectExpr("doc_id", "concat('  ', source, ' ') AS path")
    odd = t.documents.selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '..' WHEN 2 THEN concat(source, '$') "
        "ELSE concat(lang, '~1') END AS path",
    )
    names = t.paths.select("doc_id", "path").union(padded).union(odd)
    return names.select("doc_id", paths.library_name("path").alias("n")).select("doc_id", "n.*")


@check(
    "p9_enum_rejects",
    """SELECT id, concat_ws(',', CASE WHEN requested_mode NOT IN ('passive', 'restart', 'truncate') THEN 'requested_mode' END,
  CASE WHEN status NOT IN ('pending', 'running', 'retryable', 'completed', 'failed') THEN 'status' END) AS invalid
 FROM maintenance WHERE requested_mode NOT IN ('passive', 'restart', 'truncate')
  OR status NOT IN ('pending', 'running', 'retryable', 'completed', 'failed')""",
    "maintenance",
)
def _(t):
    enums = S.ENUM_COLUMNS["wal_maintenance_jobs"]
    return predicates.split_rejects(t.maintenance, enums)[1].select("id", "invalid")


@check(
    "p10_source_unchanged",
    """SELECT v.id, coalesce(v.source_size_bytes = s.size_bytes AND v.source_mtime_ns = s.mtime_ns, false) AS unchanged
 FROM variants v JOIN files f ON f.id = v.file_id
 LEFT JOIN scan s ON s.library_id = f.library_id AND s.relative_path = f.relative_path""",
    "variants files scan",
)
def _(t):
    place = t.files.select(F.col("id").alias("file_id"), "library_id", "relative_path")
    planned = t.variants.join(place, "file_id").alias("p")
    both = planned.join(t.scan.alias("s"), ["library_id", "relative_path"], "left")
    return both.select("id", predicates.source_unchanged("p", "s").alias("unchanged"))


@check(
    "f1_group_key",
    "SELECT id, hash_algorithm || ':' || content_hash_hex AS group_key FROM files",
    "files",
)
def _(t):
    return t.files.select("id", hashes.group_key("hash_algorithm", "content_hash").alias("group_key"))


@check(
    "f2_parse_group_key",
    """, t AS (SELECT doc_id, key, lower(trim(key)) AS k, split_part(lower(trim(key)), ':', 1) AS a,
  CASE WHEN contains(key, ':') THEN substr(lower(trim(key)), strpos(lower(trim(key)), ':') + 1) END AS h FROM keys),
 r AS (SELECT *, CASE WHEN k = '' THEN 'blank' WHEN NOT contains(k, ':') THEN 'no_separator' WHEN a NOT IN ('blake3', 'sha256') THEN 'unknown_algorithm'
  WHEN length(h) <> 64 THEN 'bad_length' WHEN NOT regexp_full_match(h, '[0-9a-f]*') THEN 'bad_hex' END AS reason FROM t)
 SELECT doc_id, CASE WHEN reason IS NULL THEN a END AS algorithm, CASE WHEN reason IS NULL THEN h END AS hash_hex, reason IS NULL AS ok, reason FROM r""",
    "keys",
)
def _(t):
    return t.keys.select("doc_id", hashes.parse_group_key("key").alias("p")).select(
        "doc_id", "p.algorithm", "p.hash_hex", "p.ok", "p.reason"
    )


@check("f3_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", hashes.hash_hex(hashes.content_digest("text")).alias("digest"))


@check(
    "f4_digest_algorithm",
    """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CASE doc_id % 3 WHEN 0 THEN 'sha256' ELSE 'blake3' END END AS algorithm FROM documents""",
)
def _(t):
    raw = "CASE doc_id % 3 WHEN 0 THEN ' SHA256' WHEN 1 THEN 'Blake3 ' ELSE 'md5' END"
    return t.documents.select("doc_id", hashes.digest_algorithm(F.expr(raw)).alias("algorithm"))


_GROUPED = f""", g AS (SELECT hash_algorithm, content_hash_hex, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes
 FROM files WHERE {_ELIGIBLE} GROUP BY 1, 2)"""


@check(
    "f5_group_cursor",
    _GROUPED
    + """ SELECT content_hash_hex, translate(rtrim(base64(CAST('{"content_hash_hex":"' || content_hash_hex || '","file_count":' || file_count || ',"hash_algorithm":"' || hash_algorithm || '","total_size_bytes":' || total_size_bytes || '}' AS BLOB)), '='), '+/', '-_') AS token FROM g""",
    "files",
)
def _(t):
    return _grouped(t).select(
        "content_hash_hex", cursors.group_cursor(*cursors.GroupCursor._fields).alias("token")
    )


def _grouped(t):
    return (
        t.files.filter(predicates.dedup_eligible())
        .groupBy("hash_algorithm", hashes.hash_hex("content_hash").alias("content_hash_hex"))
        .agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"))
    )


@check(
    "f6_parse_group_cursor",
    _GROUPED
    + """ SELECT content_hash_hex, CASE WHEN file_count > 1 THEN file_count END AS file_count,
 CASE WHEN file_count > 1 THEN total_size_bytes END AS total_size_bytes,
 CASE WHEN file_count > 1 THEN hash_algorithm END AS hash_algorithm FROM g""",
    "files",
)
def _(t):
    token = cursors.group_cursor(*cursors.GroupCursor._fields)
    return (
        _grouped(t)
        .select("content_hash_hex", token.alias("token"))
        .select("content_hash_hex", cursors.parse_group_cursor("token").alias("c"))
        .select("content_hash_hex", "c.file_count", "c.total_size_bytes", "c.hash_algorithm")
    )


@check(
    "f7_parse_file_cursor",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 AND user_id > 0 THEN user_id WHEN event_id % 4 = 1 AND user_id < 0 THEN -user_id END AS anchor FROM events""",
)
def _(t):
    raw = F.expr(
        "CASE event_id % 4 WHEN 0 THEN concat(' ', user_id, ' ') WHEN 1 THEN CAST(-user_id AS STRING) "
        "WHEN 2 THEN concat('x', user_id) ELSE '' END"
    )
    return t.events.select("event_id", cursors.parse_file_cursor(raw).alias("anchor"))


@check(
    "f8_page_limit",
    "SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 100 ELSE greatest(1, least(user_id * 10 - 30, 1000)) END AS page_limit FROM events",
)
def _(t):
    raw = F.expr("CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id * 10 - 30 END")
    return t.events.select("event_id", cursors.page_limit_column(raw).cast("bigint").alias("page_limit"))


@check(
    "f9_media_type",
    """SELECT id, CASE WHEN lower(relative_path) LIKE '%.jpg' OR lower(relative_path) LIKE '%.webp' THEN 'image' WHEN lower(relative_path) LIKE '%.mp4' THEN 'video' END AS media_type FROM files""",
    "files",
)
def _(t):
    return t.files.select("id", paths.media_type("relative_path").alias("media_type"))


_KEY = """sha256(CAST(id AS VARCHAR) || ':' || CASE WHEN hash_algorithm IS NULL THEN 'meta:' || size_bytes || ':' || mtime_ns
 ELSE hash_algorithm || ':' || content_hash_hex END || ':128:webp:thumb-v2')"""


@check("f10_thumb_key", f"SELECT id, {_KEY} AS thumb_key FROM files", "files")
def _(t):
    return t.files.select("id", _thumb_key().alias("thumb_key"))


def _thumb_key():
    return variants.thumb_key(
        "id", "hash_algorithm", "content_hash", "size_bytes", "mtime_ns", F.lit(128), F.lit("webp")
    )


@check(
    "f11_output_path",
    f"SELECT id, k[1:2] || '/' || k[3:4] || '/' || k || '.webp' AS output_relpath FROM (SELECT id, {_KEY} AS k FROM files)",
    "files",
)
def _(t):
    keyed = t.files.select("id", _thumb_key().alias("k"))
    return keyed.select("id", variants.output_path("k", F.lit("webp")).alias("output_relpath"))


@check(
    "f12_variant_parameters",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'webp' WHEN 1 THEN 'jpeg' WHEN 2 THEN NULL ELSE 'jpeg' END AS format,
 CASE WHEN user_id % 7 = 0 THEN 256 WHEN user_id * 5 - 20 BETWEEN 1 AND 256 THEN user_id * 5 - 20 END AS dimension,
 CASE WHEN user_id * 5 - 20 < 0 THEN 256 ELSE greatest(16, least(user_id * 5 - 20, 256)) END AS execution FROM events""",
)
def _(t):
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN ' WebP ' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'png' END")
    size = F.expr("user_id * 5 - 20")
    wanted = F.expr("CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id * 5 - 20 END")
    return t.events.select(
        "event_id",
        variants.variant_format(kind).alias("format"),
        variants.variant_dimension(wanted).cast("bigint").alias("dimension"),
        variants.execution_dimension(size).cast("bigint").alias("execution"),
    )


@check(
    "f13_retry_delay",
    "SELECT event_id, least(30 * CAST(2 ** least(greatest(user_id % 15 - 1, 0), 10) AS BIGINT), 3600) AS delay_seconds FROM events",
)
def _(t):
    delay = numbers.retry_delay_seconds(F.expr("user_id % 15"), 30, 3600)
    return t.events.select("event_id", delay.alias("delay_seconds"))


@check(
    "f15_sanitize_error",
    """SELECT doc_id, CASE WHEN length(m) > 1024 THEN substr(m, 1, 1024) || '...(truncated)' ELSE m END AS message
 FROM (SELECT doc_id, replace(replace('failed: /srv/real/libs/' || source || ' ' || text, '/srv/real/libs', '/libraries'), '/srv/thumbs', '/state/thumbs') AS m FROM documents)""",
)
def _(t):
    raw = F.concat(F.lit("failed: /srv/real/libs/"), "source", F.lit(" "), "text")
    roots = {"/srv/real/libs": S.LIBRARIES_ROOT, "/srv/thumbs": S.THUMBS_ROOT}
    clean = paths.sanitize_error(raw, roots, S.ERROR_TEXT_LIMIT)
    return t.documents.select("doc_id", clean.alias("message"))


@check(
    "f16_classify_error",
    """SELECT doc_id, CASE WHEN contains(m, 'ffmpeg') THEN 'THUMB_VIDEO_FFMPEG_FAILED' WHEN contains(m, 'path') OR contains(m, 'escape') THEN 'THUMB_PATH_POLICY_REJECTED'
 WHEN contains(m, 'format') OR contains(m, 'decode') THEN 'THUMB_DECODE_FAILED' ELSE 'THUMB_GENERATION_FAILED' END AS code
 FROM (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'FFmpeg exited, bad path' WHEN 1 THEN 'Path escapes' WHEN 2 THEN 'unknown FORMAT' ELSE text END) AS m FROM documents)""",
)
def _(t):
    message = F.expr(
        "CASE doc_id % 5 WHEN 0 THEN 'FFmpeg exited, bad path' WHEN 1 THEN 'Path escapes' "
        "WHEN 2 THEN 'unknown FORMAT' ELSE text END"
    )
    return t.documents.select("doc_id", variants.classify_error(message).alias("code"))


@check(
    "f17_default_if_blank",
    "SELECT id, CASE WHEN error_code IS NULL OR trim(error_code) = '' THEN 'LEASE_EXPIRED' ELSE error_code END AS error_code FROM jobs",
    "jobs",
)
def _(t):
    return t.jobs.select("id", common.default_if_blank("error_code", S.LEASE_EXPIRED).alias("error_code"))


@check(
    "f18_payload_options",
    """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS batch_size,
 CASE WHEN event_id % 5 = 2 THEN event_type END AS algorithm,
 CASE WHEN event_id % 5 = 3 THEN event_type || '|x,null,y' WHEN event_id % 5 = 1 THEN '' END AS names,
 CASE WHEN event_id % 5 = 4 THEN CASE WHEN user_id % 2 = 0 THEN 'not_an_array' ELSE 'not_strings' END END AS names_error FROM events""",
)
def _(t):
    payload = F.expr(
        """CASE event_id % 5 WHEN 0 THEN replace(props, '"k"', '"batch_size"')
 WHEN 1 THEN concat('{"library_names":[],', substr(replace(props, '"k"', '"batch_size"'), 2))
 WHEN 2 THEN concat('{"batch_size":-', user_id + 1, ',"algorithm":"', event_type, '","library_names":null}')
 WHEN 3 THEN concat('{"batch_size":1.5,"algorithm":7,"library_names":["', event_type, '","x,null,y"]}')
 ELSE concat('{"batch_size":"9","library_names":', IF(user_id % 2 = 0, '"one"', '["a",null]'), '}') END"""
    )
    names = numbers.payload_string_list("payload", "library_names")
    return t.events.select("event_id", payload.alias("payload")).select(
        "event_id",
        numbers.payload_uint("payload", "batch_size").alias("batch_size"),
        numbers.payload_string("payload", "algorithm").alias("algorithm"),
        F.array_join(names["names"], "|").alias("names"),
        names["error"].alias("names_error"),
    )


@check(
    "f19_format_bytes",
    """, s AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS line, CAST(floor(l.l_extendedprice) AS BIGINT) * CAST(l.l_quantity AS BIGINT) * CASE l.l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 512 WHEN 2 THEN 100000 ELSE 50 END // 48 AS size FROM lineitem l),
 u AS (SELECT line, size, CASE WHEN size >= 1024 ** 4 THEN 4 WHEN size >= 1024 ** 3 THEN 3 WHEN size >= 1024 ** 2 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS level FROM s)
 SELECT line, size, CASE WHEN level < 2 THEN CAST(CAST(floor(size / (1024 ** level) + 0.5) AS BIGINT) AS VARCHAR)
  ELSE printf('%.1f', floor(size / (1024 ** level) * 10 + 0.5) / 10) END || ' ' || ['B', 'KiB', 'MiB', 'GiB', 'TiB'][level + 1] AS text FROM u""".replace(
        ", s AS", "WITH s AS", 1
    ),
)
def _(t):
    size = F.expr(
        "floor(l_extendedprice) * CAST(l_quantity AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 "
        "WHEN 1 THEN 512 WHEN 2 THEN 100000 ELSE 50 END div 48"
    )
    lines = t.base("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("line"), size.alias("size"))
    return lines.select("line", "size", numbers.format_bytes("size").alias("text"))


@check("f21_utc_times", "SELECT event_id, epoch_us(ts) AS ts_us FROM events")
def _(t):
    return t.events.select("event_id", F.unix_micros(common.utc("ts")).alias("ts_us"))


@check(
    "f22_posix_path",
    """SELECT doc_id, CASE WHEN len(parts) > 0 AND NOT list_contains(parts, '..') THEN array_to_string(parts, '/') END AS path
 FROM (SELECT doc_id, list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.')) AS parts FROM paths)""",
    "paths",
)
def _(t):
    return t.paths.select("doc_id", paths.posix_path("path").alias("path"))


@check(
    "f23_digest_shape",
    """SELECT doc_id, coalesce(a IN ('blake3', 'sha256') AND regexp_full_match(h, '[0-9a-f]{64}'), false) AS valid
 FROM (SELECT doc_id, split_part(lower(trim(key)), ':', 1) AS a, split_part(lower(trim(key)), ':', 2) AS h FROM keys)""",
    "keys",
)
def _(t):
    token = F.lower(common.strip("key"))
    digest = F.try_to_binary(F.split_part(token, F.lit(":"), F.lit(2)), F.lit("hex"))
    shape = hashes.valid_digest_shape(F.split_part(token, F.lit(":"), F.lit(1)), digest)
    return t.keys.select("doc_id", F.coalesce(shape, F.lit(False)).alias("valid"))


@check(
    "f24_io_budget",
    "SELECT seq, CASE WHEN bytes <= 0 THEN 0 ELSE greatest((bytes * 1000 + 7 * 1048576 - 1) // (7 * 1048576), 1) END AS budget_ms FROM requests",
    "requests",
)
def _(t):
    return t.requests.select("seq", numbers.io_budget_ms("bytes", 7).alias("budget_ms"))


@check(
    "m1_conform",
    """SELECT id, requested_mode, status, CAST(retry_count AS BIGINT) AS retry_count, worker_id IS NULL AS no_worker FROM (SELECT *, CAST(NULL AS VARCHAR) AS worker_id FROM maintenance)""",
    "maintenance",
)
def _(t):
    # An older table: a column that is gone today, others that did not exist yet.
    old = t.maintenance.withColumn("execution_backend", F.lit("x"))
    return conform(old, "wal_maintenance_jobs", NOW).select(
        "id",
        "requested_mode",
        "status",
        F.col("retry_count").cast("bigint").alias("retry_count"),
        F.col("worker_id").isNull().alias("no_worker"),
    )
