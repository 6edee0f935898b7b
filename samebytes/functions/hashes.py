"""digests and group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from samebytes.functions.common import col, strip, verdict
from samebytes.schemas import HASH_ALGORITHMS

HEX_LENGTH = 64


def hash_hex(digest: Column | str) -> Column:
    return F.lower(F.hex(col(digest)))


def group_key(algorithm: Column | str, digest: Column | str) -> Column:
    """`algorithm:hex`, NULL when either part is NULL."""
    return F.concat(col(algorithm), F.lit(":"), hash_hex(digest))


def read_group_key(key: str) -> tuple[str, bytes]:
    """F2 for one request: algorithm and digest."""
    algorithm, separator, text = key.strip().lower().partition(":")
    if not separator:
        raise ValueError("a group key is written as algorithm:hex")
    if algorithm not in HASH_ALGORITHMS:
        raise ValueError(f"group key names an unknown algorithm: {algorithm}")
    if len(text) != HEX_LENGTH or set(text) - set("0123456789abcdef"):
        raise ValueError(f"group key needs {HEX_LENGTH} hex digits")
    return algorithm, bytes.fromhex(text)


def parse_group_key(key: Column | str) -> Column:
    """`struct(algorithm, hash_hex, content_hash, ok, reason)` of a textual key."""
    token = F.lower(strip(key))
    algorithm = F.substring_index(token, ":", 1)
    text = F.when(token.contains(":"), F.substr(token, F.length(algorithm) + 2))
    digest = F.try_to_binary(text, F.lit("hex"))
    checked = verdict(
        (token.isNull() | (token == ""), "blank"),
        (~token.contains(":"), "no_separator"),
        (~algorithm.isin(*HASH_ALGORITHMS), "unknown_algorithm"),
        (F.length(text) != HEX_LENGTH, "bad_length"),
        (digest.isNull() | ~text.rlike("^[0-9a-f]*$"), "bad_hex"),
    )
    ok = checked["ok"]
    return F.struct(
        F.when(ok, algorithm).alias("algorithm"),
        F.when(ok, text).alias("hash_hex"),
        F.when(ok, digest).alias("content_hash"),
        ok.alias("ok"),
        checked["reason"].alias("reason"),
    )


def content_digest(content: Column | str) -> Column:
    """SHA-256 of whole content held in a column, as 32 bytes."""
    return F.unhex(F.sha2(col(content), 256))


def digest_algorithm(name: Column | str) -> Column:
    """normalised algorithm name; NULL and unknown names give NULL."""
    token = F.lower(strip(name))
    return F.when(token.isin(*HASH_ALGORITHMS), token)


def valid_digest_shape(algorithm: Column | str, digest: Column | str) -> Column:
    """both algorithms produce 32 bytes."""
    return col(algorithm).isin(*HASH_ALGORITHMS) & (F.octet_length(col(digest)) * 2 == HEX_LENGTH)
