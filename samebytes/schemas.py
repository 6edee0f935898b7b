"""Table schemas, legal values and defaults.

Everything in the "fixed values" blocks is data that stored tables contain, so it
has to stay exactly as it is for catalogs to remain readable.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: legal contents of the enumerated columns ------------------
HASH_ALGORITHMS = ("blake3", "sha256")
JOB_KINDS = ("scan", "hash", "delete", "thumbnail")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled", "retryable")
VARIANT_STATUSES = ("pending", "running", "ready", "failed")
MEDIA_TYPES = ("image", "video")
VARIANT_FORMATS = ("jpeg", "webp")
CLEANUP_STATUSES = ("pending", "running", "completed", "failed")
SCAN_STATUSES = ("running", "succeeded", "failed")
MAINTENANCE_MODES = ("passive", "restart", "truncate")
MAINTENANCE_STATUSES = ("pending", "running", "retryable", "completed", "failed")

# --- fixed values: file suffixes per media type ------------------------------
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp")
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".mpeg", ".mpg", ".wmv")

# --- fixed values: legal job status changes (from, to) -----------------------
JOB_TRANSITIONS = (
    ("pending", "running"),
    ("pending", "cancelled"),
    ("running", "completed"),
    ("running", "failed"),
    ("running", "cancelled"),
    ("running", "retryable"),
    ("retryable", "pending"),
    ("retryable", "cancelled"),
    ("retryable", "failed"),
)

# --- fixed values: codes and messages stored by recovery operators -----------
LEASE_EXPIRED = "LEASE_EXPIRED"
MUTEX_RECOVERY = "MIGRATION_MUTEX_RECOVERY"
ACTIVE_RECOVERY = "MIGRATION_ACTIVE_RECOVERY"
LEASE_EXPIRED_CONTROL_MESSAGE = "Lease expired and recovered by control plane"
LEASE_EXPIRED_CLAIM_MESSAGE = "Lease expired and recovered by rust worker claim path"
LEASE_EXPIRED_REQUEUE_MESSAGE = "Lease expired and requeued by rust worker claim path"
MUTEX_RECOVERY_MESSAGE = (
    "Reclassified during migration to satisfy single running scan/hash invariant"
)
ACTIVE_RECOVERY_MESSAGE = (
    "Reclassified during migration to satisfy single pending/running scan/hash invariant"
)

# --- fixed values: variant naming --------------------------------------------
VARIANT_KEY_SUFFIX = "thumb-v2"
VARIANT_VERSION = 2

# --- fixed values: default settings ------------------------------------------
LIBRARIES_ROOT = "/libraries"
THUMBS_ROOT = "/state/thumbs"
LEASE_TTL_SECONDS = 300
HASH_CLAIM_TTL_SECONDS = 600
HASH_FETCH_BATCH = 512
HASH_READ_CHUNK_BYTES = 4 * 1024 * 1024
HASH_RETRY_SECONDS = (30, 3600)
VARIANT_RETRY_SECONDS = (30, 1800)
VARIANT_MAX_DIMENSION = 256
VARIANT_DEFAULT_FORMAT = "jpeg"
VARIANT_CAPACITY = 50_000
VARIANT_CONCURRENCY = {"image": 2, "video": 1}
CLEANUP_DELAY_SECONDS = 600
MAINTENANCE_RETRY_SECONDS = 120
PAGE_SIZE = (100, 1000)
JOB_PAGE_SIZE = (50, 200)
ERROR_TEXT_LIMIT = 1024


def _table(ddl: str) -> T.StructType:
    """A schema from DDL, without the session that Spark's own parser needs."""
    kinds = {
        "bigint": T.LongType(),
        "int": T.IntegerType(),
        "string": T.StringType(),
        "boolean": T.BooleanType(),
        "double": T.DoubleType(),
        "timestamp": T.TimestampType(),
        "binary": T.BinaryType(),
    }
    columns = [column.split(maxsplit=2) for column in ddl.split(",")]
    return T.StructType([T.StructField(name, kinds[kind], not rest) for name, kind, *rest in columns])


# --- fixed values: columns of the stored tables ------------------------------
LIBRARY_ROOTS = _table("""
    id bigint NOT NULL,
    name string NOT NULL,
    root_path string NOT NULL,
    created_at timestamp,
    updated_at timestamp,
    last_scanned_at timestamp
""")

LIBRARY_FILES = _table("""
    id bigint NOT NULL,
    library_id bigint NOT NULL,
    relative_path string NOT NULL,
    size_bytes bigint NOT NULL,
    mtime_ns bigint NOT NULL,
    inode bigint,
    device bigint,
    is_missing boolean NOT NULL,
    needs_hash boolean NOT NULL,
    last_seen_scan_id bigint,
    hash_algorithm string,
    content_hash binary,
    hashed_size_bytes bigint,
    hashed_mtime_ns bigint,
    hashed_at timestamp,
    hash_error_count int NOT NULL,
    hash_last_error string,
    hash_last_error_at timestamp,
    hash_retry_after timestamp,
    hash_claim_token string,
    hash_claimed_at timestamp,
    created_at timestamp,
    updated_at timestamp
""")

SCAN_SESSIONS = _table("""
    id bigint NOT NULL,
    status string NOT NULL,
    started_at timestamp,
    finished_at timestamp,
    error_message string,
    files_seen bigint NOT NULL,
    directories_seen bigint NOT NULL,
    bytes_seen bigint NOT NULL,
    error_count int NOT NULL
""")

JOBS = _table("""
    id string NOT NULL,
    kind string NOT NULL,
    status string NOT NULL,
    dry_run boolean NOT NULL,
    worker_id string,
    worker_heartbeat_at timestamp,
    lease_expires_at timestamp,
    progress double NOT NULL,
    total_items int,
    processed_items int NOT NULL,
    payload string,
    error_code string,
    error_message string,
    created_at timestamp,
    updated_at timestamp,
    started_at timestamp,
    finished_at timestamp
""")

THUMBNAILS = _table("""
    id bigint NOT NULL,
    thumb_key string NOT NULL,
    file_id bigint NOT NULL,
    group_key string,
    status string NOT NULL,
    media_type string NOT NULL,
    format string NOT NULL,
    max_dimension int NOT NULL,
    version int NOT NULL,
    source_size_bytes bigint NOT NULL,
    source_mtime_ns bigint NOT NULL,
    output_relpath string,
    width int,
    height int,
    bytes_size bigint,
    error_code string,
    error_message string,
    error_count int NOT NULL,
    retry_after timestamp,
    worker_id string,
    worker_heartbeat_at timestamp,
    lease_expires_at timestamp,
    created_at timestamp,
    updated_at timestamp,
    started_at timestamp,
    finished_at timestamp
""")

CLEANUP_JOBS = _table("""
    id bigint NOT NULL,
    group_key string NOT NULL,
    status string NOT NULL,
    execute_after timestamp NOT NULL,
    worker_id string,
    worker_heartbeat_at timestamp,
    lease_expires_at timestamp,
    error_code string,
    error_message string,
    created_at timestamp,
    updated_at timestamp,
    finished_at timestamp
""")

MAINTENANCE_JOBS = _table("""
    id bigint NOT NULL,
    requested_mode string NOT NULL,
    status string NOT NULL,
    requested_by string,
    reason string,
    execute_after timestamp NOT NULL,
    retry_count int NOT NULL,
    retry_after timestamp,
    worker_id string,
    worker_heartbeat_at timestamp,
    lease_expires_at timestamp,
    checkpoint_busy int,
    checkpoint_log_frames int,
    checkpointed_frames int,
    error_code string,
    error_message string,
    created_at timestamp,
    updated_at timestamp,
    started_at timestamp,
    finished_at timestamp
""")

IO_RATE_LIMITS = _table("""
    bucket_key string NOT NULL,
    next_available_at_ms bigint NOT NULL,
    updated_at timestamp
""")

# Totals of every content that an eligible file has, single files included.
CONTENT_TOTALS = _table("""
    hash_algorithm string NOT NULL,
    content_hash binary NOT NULL,
    file_count bigint NOT NULL,
    total_size_bytes bigint NOT NULL,
    smallest_size_bytes bigint NOT NULL,
    sample_file_id bigint NOT NULL
""")

# --- fixed values: defaults of columns that older tables may lack ------------
COLUMN_DEFAULTS = {
    "library_files": {"is_missing": False, "needs_hash": True, "hash_error_count": 0},
    "scan_sessions": {
        "status": "running",
        "files_seen": 0,
        "directories_seen": 0,
        "bytes_seen": 0,
        "error_count": 0,
    },
    "jobs": {"status": "pending", "dry_run": True, "progress": 0.0, "processed_items": 0},
    "thumbnails": {"status": "pending", "version": VARIANT_VERSION, "error_count": 0},
    "thumbnail_cleanup_jobs": {"status": "pending"},
    "wal_maintenance_jobs": {
        "requested_mode": "passive",
        "status": "pending",
        "retry_count": 0,
    },
    "io_rate_limits": {"next_available_at_ms": 0},
    "library_roots": {},
    "content_totals": {},
}

TABLES = {
    "library_roots": LIBRARY_ROOTS,
    "library_files": LIBRARY_FILES,
    "scan_sessions": SCAN_SESSIONS,
    "jobs": JOBS,
    "thumbnails": THUMBNAILS,
    "thumbnail_cleanup_jobs": CLEANUP_JOBS,
    "wal_maintenance_jobs": MAINTENANCE_JOBS,
    "io_rate_limits": IO_RATE_LIMITS,
    "content_totals": CONTENT_TOTALS,
}

# Enumerated columns per table, for validation and case normalisation.
ENUM_COLUMNS = {
    "library_files": {"hash_algorithm": HASH_ALGORITHMS},
    "scan_sessions": {"status": SCAN_STATUSES},
    "jobs": {"kind": JOB_KINDS, "status": JOB_STATUSES},
    "thumbnails": {
        "status": VARIANT_STATUSES,
        "media_type": MEDIA_TYPES,
        "format": VARIANT_FORMATS,
    },
    "thumbnail_cleanup_jobs": {"status": CLEANUP_STATUSES},
    "wal_maintenance_jobs": {
        "requested_mode": MAINTENANCE_MODES,
        "status": MAINTENANCE_STATUSES,
    },
}

# Keys that must be unique, per table.
UNIQUE_KEYS = {
    "library_files": ("library_id", "relative_path"),
    "thumbnails": ("thumb_key",),
    "thumbnail_cleanup_jobs": ("group_key",),
    "content_totals": ("hash_algorithm", "content_hash"),
}

# One entry seen while walking a file tree.
TREE_ENTRIES = _table("""
    library string NOT NULL,
    kind string NOT NULL,
    relative_path string,
    size_bytes bigint,
    mtime_ns bigint,
    inode bigint,
    device bigint,
    error string
""")

# Result of hashing one candidate.
HASH_OUTCOMES = _table("""
    id bigint NOT NULL,
    outcome string NOT NULL,
    digest binary,
    size_bytes bigint,
    mtime_ns bigint,
    inode bigint,
    device bigint,
    bytes_hashed bigint NOT NULL,
    error string
""")
