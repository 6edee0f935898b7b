"""Views over the test tables that stand in for catalog and queue tables.

The same text runs on both engines; DuckDB only gets other names for two functions. All
views cover their whole base tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samebytes.operators.conform import conform

NOW = "2024-01-16 00:00:00"
BASE = ("documents", "events", "labels", "pages")

_VIEWS = {
    "files": """
SELECT doc_id + 1 AS id, CAST(substr(source, 4) AS BIGINT) + 1 AS library_id,
 concat(lang, '/d', CAST(doc_id % 10 AS STRING), '/doc-', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' ELSE '' END) AS relative_path,
 CAST(octet_length(text) AS BIGINT) AS size_bytes, 1700000000000000000 + doc_id AS mtime_ns,
 CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id + 1000 END AS inode, CAST(64 AS BIGINT) AS device,
 doc_id % 17 = 5 AS is_missing, doc_id % 13 = 7 AS needs_hash,
 CASE WHEN text IS NULL OR doc_id % 13 = 7 AND doc_id % 2 = 0 THEN NULL ELSE 'sha256' END AS hash_algorithm,
 CASE WHEN text IS NULL OR doc_id % 13 = 7 AND doc_id % 2 = 0 THEN NULL ELSE sha2(text, 256) END AS content_hash_hex,
 doc_id % 4 AS hash_error_count,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-16 00:00:00' + (doc_id % 7 - 3) * INTERVAL '1' HOUR END AS hash_retry_after,
 CASE WHEN doc_id % 6 = 1 THEN NULL ELSE concat('claim-', CAST(doc_id % 5 AS STRING)) END AS hash_claim_token,
 CASE WHEN doc_id % 8 = 2 THEN NULL ELSE TIMESTAMP '2024-01-16 00:00:00' + (doc_id % 11 - 9) * INTERVAL '2' MINUTE END AS hash_claimed_at,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS last_seen_scan_id
 FROM {documents}""",
    # The files with every column of the catalog.
    "catalog": """
SELECT f.*, size_bytes AS hashed_size_bytes, mtime_ns AS hashed_mtime_ns,
 CASE WHEN hash_algorithm IS NULL THEN NULL ELSE TIMESTAMP '2024-01-10 00:00:00' + (id % 30) * INTERVAL '1' HOUR END AS hashed_at,
 CASE WHEN id % 4 = 1 THEN 'Input/output error' END AS hash_last_error,
 CASE WHEN id % 4 = 1 THEN TIMESTAMP '2024-01-11 00:00:00' + (id % 9) * INTERVAL '1' MINUTE END AS hash_last_error_at,
 TIMESTAMP '2024-01-01 00:00:00' + (id % 40) * INTERVAL '1' HOUR AS created_at, TIMESTAMP '2024-01-12 00:00:00' AS updated_at FROM {files} f""",
    "roots": """
SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS id, concat('lib-', substr(source, 4)) AS name, concat('/libraries/lib-', substr(source, 4)) AS root_path FROM {documents}""",
    # A later scan: toxic documents are gone, low quality ones were edited, pages are new.
    "scan": """
SELECT f.library_id, f.relative_path, f.size_bytes + CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS size_bytes,
 f.mtime_ns + CASE WHEN f.id % 11 = 4 THEN 5 ELSE 0 END AS mtime_ns, f.inode, f.device
 FROM {files} f LEFT JOIN {labels} l ON l.doc_id + 1 = f.id WHERE coalesce(l.toxic, 0) = 0
 UNION ALL
SELECT page_id % 20 + 1 AS library_id, concat('pages/', CAST(page_id AS STRING), '.html') AS relative_path, CAST(octet_length(html) AS BIGINT) AS size_bytes, 1700000000000000000 + page_id AS mtime_ns, page_id + 5000000 AS inode, CAST(64 AS BIGINT) AS device
 FROM {pages}""",
    # Every library of the catalog was walked, but for the last one.
    "scanned": """
SELECT DISTINCT library_id FROM {files} WHERE library_id < (SELECT max(library_id) FROM {files})""",
    "jobs": """
SELECT concat('job-', lpad(CAST(event_id AS STRING), 8, '0')) AS id,
 CASE event_type WHEN 'view' THEN 'scan' WHEN 'click' THEN 'hash' WHEN 'purchase' THEN 'thumbnail' ELSE 'delete' END AS kind,
 CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'retryable' END AS status,
 CASE WHEN event_id % 10 = 1 THEN NULL ELSE CAST(ts AS TIMESTAMP) + (user_id % 30) * INTERVAL '1' DAY END AS lease_expires_at,
 CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'E_OLD' END AS error_code,
 CASE event_id % 3 WHEN 0 THEN NULL ELSE 'old message' END AS error_message,
 concat('worker-', CAST(user_id AS STRING)) AS worker_id,
 CASE event_id % 6 WHEN 2 THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR END AS finished_at,
 props AS payload, CAST(ts AS TIMESTAMP) AS created_at FROM {events}""",
    "requests": """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS requested_at, user_id * 3 + event_id % 3 + 1 AS file_id, CASE event_id % 3 WHEN 0 THEN 128 ELSE 256 END AS max_dimension, CASE event_id % 2 WHEN 0 THEN 'jpeg' ELSE 'webp' END AS output_format, CAST(floor(value * 1048576) AS BIGINT) AS bytes FROM {events}""",
    "variants": """
SELECT id, sha2(concat(CAST(id AS STRING), ':', CASE WHEN hash_algorithm IS NULL THEN concat('meta:', CAST(size_bytes AS STRING), ':', CAST(mtime_ns AS STRING)) ELSE concat(hash_algorithm, ':', content_hash_hex) END, ':256:jpeg:thumb-v2'), 256) AS thumb_key, id AS file_id, CASE WHEN hash_algorithm IS NULL THEN NULL ELSE concat(hash_algorithm, ':', content_hash_hex) END AS group_key,
 CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'ready' ELSE 'failed' END AS status,
 CASE WHEN lower(relative_path) LIKE '%.mp4' THEN 'video' ELSE 'image' END AS media_type, 'jpeg' AS format, 256 AS max_dimension,
 size_bytes AS source_size_bytes, mtime_ns AS source_mtime_ns, id % 3 AS error_count,
 CASE WHEN id % 8 = 3 THEN NULL ELSE TIMESTAMP '2024-01-16 00:00:00' + (id % 5 - 2) * INTERVAL '1' HOUR END AS retry_after,
 CASE WHEN id % 12 = 1 THEN NULL ELSE TIMESTAMP '2024-01-16 00:00:00' + (id % 9 - 4) * INTERVAL '1' MINUTE END AS lease_expires_at,
 CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'E_OLD' END AS error_code,
 CASE WHEN id % 7 = 0 THEN NULL ELSE concat('aa/bb/', CAST(id AS STRING), '.jpg') END AS output_relpath,
 TIMESTAMP '2024-01-10 00:00:00' + (id % 50) * INTERVAL '1' HOUR AS created_at
 FROM {files} WHERE lower(relative_path) LIKE '%.jpg' OR lower(relative_path) LIKE '%.mp4' OR lower(relative_path) LIKE '%.webp'""",
    "cleanups": """
SELECT min(id) AS id, group_key, CASE min(id) % 3 WHEN 0 THEN 'running' ELSE 'pending' END AS status,
 TIMESTAMP '2024-01-16 00:00:00' + (min(id) % 7 - 5) * INTERVAL '1' HOUR AS execute_after,
 CASE WHEN min(id) % 4 = 3 THEN NULL ELSE TIMESTAMP '2024-01-16 00:00:00' + (min(id) % 5 - 3) * INTERVAL '1' MINUTE END AS lease_expires_at,
 CASE WHEN min(id) % 2 = 0 THEN NULL ELSE 'E_OLD' END AS error_code
 FROM {variants} WHERE group_key IS NOT NULL GROUP BY group_key""",
    # Maintenance jobs as an older release stored them: mixed case and gaps.
    "maintenance": """
SELECT event_id + 1 AS id,
 CASE event_id % 3 WHEN 0 THEN 'PASSIVE' WHEN 1 THEN 'restart' ELSE 'Truncate' END AS requested_mode,
 CASE event_id % 5 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'running' WHEN 2 THEN 'retryable' WHEN 3 THEN 'COMPLETED' ELSE 'failed' END AS status,
 CAST(ts AS TIMESTAMP) + INTERVAL '30' MINUTE AS execute_after, event_id % 4 AS retry_count,
 CASE WHEN user_id % 2 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL '2' HOUR END AS retry_after,
 CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + (user_id % 20) * INTERVAL '1' DAY END AS lease_expires_at,
 CASE event_id % 5 WHEN 3 THEN CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR END AS finished_at,
 CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'E_OLD' END AS error_code,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS created_at,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL '5' MINUTE END AS updated_at
 FROM {events}""",
    # Entries of a walk: files, their directories and some that could not be read.
    "entries": """
SELECT concat('lib-', CAST(library_id AS STRING)) AS library, CASE WHEN is_missing THEN 'error' ELSE 'file' END AS kind, relative_path,
 CASE WHEN is_missing THEN NULL ELSE size_bytes END AS size_bytes, CASE WHEN is_missing THEN 'Permission denied' END AS error FROM {files}
 UNION ALL
SELECT DISTINCT concat('lib-', CAST(library_id AS STRING)) AS library, 'directory' AS kind, regexp_replace(relative_path, '/[^/]*$', '') AS relative_path, CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS STRING) AS error FROM {files}""",
    # Outcomes of hashing all due files.
    "outcomes": """
SELECT id, CASE id % 4 WHEN 0 THEN 'hashed' WHEN 1 THEN 'requeued' WHEN 2 THEN 'missing' ELSE 'failed' END AS outcome,
 CASE WHEN id % 4 = 0 THEN sha2(relative_path, 256) END AS digest_hex,
 CASE WHEN id % 4 < 2 THEN size_bytes + id % 4 END AS size_bytes, CASE WHEN id % 4 < 2 THEN mtime_ns + id % 4 END AS mtime_ns,
 inode, device, CASE WHEN id % 4 = 0 THEN size_bytes ELSE 0 END AS bytes_hashed, CASE WHEN id % 4 = 3 THEN 'Input/output error' END AS error
 FROM {files} WHERE needs_hash AND NOT is_missing""",
    # A log of variant requests with their latency.
    "log": """
SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'queue_full' ELSE 'accepted' END AS status,
 concat('key-', CAST(user_id AS STRING)) AS thumb_key, value AS latency_ms,
 CASE event_type WHEN 'error' THEN concat('RuntimeError:', props) END AS error FROM {events}""",
    # Paths of which most break some rule.
    "paths": """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('/', lang, '/x.bin') WHEN 1 THEN concat('../', source) WHEN 2 THEN concat(lang, '/../../', source) WHEN 3 THEN concat('~/', source) WHEN 4 THEN concat('$HOME/', source)
 WHEN 5 THEN concat(lang, '//./', source, '/') WHEN 6 THEN concat(lang, '/..', source, '/a..b') ELSE concat(lang, '/', source, '.Tar.GZ') END AS path,
 concat('/libraries/lib-', substr(source, 4)) AS root FROM {documents}""",
    # Group keys of which most are malformed.
    "keys": """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('sha256:', sha2(text, 256)) WHEN 1 THEN concat('  SHA256:', upper(sha2(text, 256)), ' ') WHEN 2 THEN concat('blake3:', substr(sha2(text, 256), 3))
 WHEN 3 THEN concat('md5:', sha2(text, 256)) WHEN 4 THEN '   ' WHEN 5 THEN sha2(text, 256) ELSE concat('blake3:', substr(sha2(text, 256), 3), 'zz') END AS key FROM {documents}""",
}
_NEEDS = {
    "catalog": ("files",),
    "scan": ("files",),
    "scanned": ("files",),
    "variants": ("files",),
    "cleanups": ("variants",),
    "entries": ("files",),
    "outcomes": ("files",),
}


def with_views(names: tuple[str, ...]) -> str:
    """`WITH ...` clause that defines the views for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    plain = {name: name for name in (*BASE, *_VIEWS)}
    parts = []
    for name in order:
        text = _VIEWS[name].format(**plain)
        text = text.replace("octet_length(", "strlen(").replace("sha2(", "sha256(")
        text = text.replace(", 256)", ")")
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


class Tables:
    """The test tables and views of one scale as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in _VIEWS:
            raise AttributeError(name)
        text = _VIEWS[name]
        inputs = {n: getattr(self, f"_{n}", None) or getattr(self, n)
                  for n in (*BASE, *_VIEWS) if f"{{{n}}}" in text}
        return self.spark.sql(text, **inputs)

    @cached_property
    def _files(self) -> DataFrame:
        return self.spark.sql(_VIEWS["files"], documents=self.documents)

    @cached_property
    def files(self) -> DataFrame:
        """With the digest as bytes, as catalogs hold it.

        A digest is there exactly if an algorithm is. Saying so lets the optimizer test that
        without hashing every text a second time.
        """
        digest = F.coalesce(F.unhex("content_hash_hex"), F.lit(b""))
        digest = F.when(F.col("hash_algorithm").isNotNull(), digest)
        return self._files.withColumn("content_hash", digest).drop("content_hash_hex")

    @cached_property
    def catalog(self) -> DataFrame:
        """A catalog table without a default in it."""
        rows = self.spark.sql(_VIEWS["catalog"], files=self._files)
        return conform(rows.withColumn("content_hash", F.unhex("content_hash_hex")), "library_files")

    @cached_property
    def outcomes(self) -> DataFrame:
        text = self.spark.sql(_VIEWS["outcomes"], files=self._files)
        return text.withColumn("digest", F.unhex("digest_hex")).drop("digest_hex")
