"""Naming and parameters of derived variants (thumbnails)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samebytes.functions.common import col, strip
from samebytes.functions.hashes import group_key
from samebytes.schemas import (
    VARIANT_DEFAULT_FORMAT,
    VARIANT_FORMATS,
    VARIANT_KEY_SUFFIX,
    VARIANT_MAX_DIMENSION,
)


def thumb_key(
    file_id: Column | str,
    algorithm: Column | str,
    digest: Column | str,
    size_bytes: Column | str,
    mtime_ns: Column | str,
    max_dimension: Column | str,
    output_format: Column | str,
) -> Column:
    """fingerprint of one variant of one version of a file."""
    metadata = F.concat_ws(":", F.lit("meta"), col(size_bytes), col(mtime_ns))
    source = F.coalesce(group_key(algorithm, digest), metadata)
    return F.sha2(
        F.concat_ws(
            ":",
            col(file_id).cast("string"),
            source,
            col(max_dimension).cast("string"),
            col(output_format),
            F.lit(VARIANT_KEY_SUFFIX),
        ),
        256,
    )


def output_path(key: Column | str, output_format: Column | str) -> Column:
    """two levels of shards by the first four hex digits."""
    key = col(key)
    extension = F.when(col(output_format) == "jpeg", F.lit(".jpg")).otherwise(F.lit(".webp"))
    slash = F.lit("/")
    return F.concat(
        F.substring(key, 1, 2), slash, F.substring(key, 3, 2), slash, key, extension
    )


def variant_format(raw: Column | str, default: str = VARIANT_DEFAULT_FORMAT) -> Column:
    """normalised format; NULL input means the default, NULL output means unsupported."""
    raw = col(raw)
    token = F.lower(strip(raw))
    return F.when(raw.isNull(), F.lit(default)).when(token.isin(*VARIANT_FORMATS), token)


def variant_dimension(raw: Column | str, largest: int = VARIANT_MAX_DIMENSION) -> Column:
    """requested edge length; NULL input means the largest, NULL output means refused."""
    raw = col(raw)
    return F.when(raw.isNull(), F.lit(largest)).when((raw > 0) & (raw <= largest), raw)


def execution_dimension(planned: Column | str, largest: int = VARIANT_MAX_DIMENSION) -> Column:
    """edge length a worker really renders, never below 16."""
    planned = col(planned)
    return F.when(planned < 0, F.lit(max(largest, 16))).otherwise(
        F.greatest(F.lit(16), F.least(planned, F.lit(largest)))
    )


def classify_error(message: Column | str) -> Column:
    """F16: error code by the first word that occurs, in any letter case."""
    text = F.lower(col(message))
    # fixed values: words and codes, in order of precedence
    rules = (
        (("ffmpeg",), "THUMB_VIDEO_FFMPEG_FAILED"),
        (("path", "escape"), "THUMB_PATH_POLICY_REJECTED"),
        (("format", "decode"), "THUMB_DECODE_FAILED"),
    )
    code = F.lit("THUMB_GENERATION_FAILED")
    for words, name in reversed(rules):
        code = F.when(text.rlike("|".join(words)), F.lit(name)).otherwise(code)
    return code
