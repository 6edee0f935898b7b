"""Page cursors and page sizes, on columns and for single requests."""

from __future__ import annotations

import base64
import json
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from samebytes.functions.common import col, strip
from samebytes.functions.hashes import HEX_LENGTH
from samebytes.schemas import HASH_ALGORITHMS, PAGE_SIZE


class InvalidCursor(ValueError):
    """A cursor that this library did not hand out."""


class GroupCursor(NamedTuple):
    """Position after one duplicate group; fields are in sort order."""

    file_count: int
    total_size_bytes: int
    hash_algorithm: str
    content_hash_hex: str

    def check(self) -> "GroupCursor":
        if self.file_count < 2 or self.total_size_bytes < 0:
            raise InvalidCursor("group cursor counts are out of range")
        if self.hash_algorithm not in HASH_ALGORITHMS:
            raise InvalidCursor("group cursor names an unknown algorithm")
        if len(self.content_hash_hex) != HEX_LENGTH or set(self.content_hash_hex) - set(
            "0123456789abcdef"
        ):
            raise InvalidCursor("group cursor hash is malformed")
        return self


def encode_group_cursor(cursor: GroupCursor) -> str:
    text = json.dumps(cursor._asdict(), sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_group_cursor(token: str) -> GroupCursor:
    token = token.strip()
    try:
        fields = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        cursor = GroupCursor(
            int(fields["file_count"]),
            int(fields["total_size_bytes"]),
            str(fields["hash_algorithm"]).lower(),
            str(fields["content_hash_hex"]).lower(),
        )
    except (ValueError, KeyError, TypeError) as error:
        raise InvalidCursor("group cursor cannot be read") from error
    return cursor.check()


def decode_file_cursor(token: str | None) -> int | None:
    """F7 for one request: the id of the last file seen, at least 1."""
    if token is None:
        return None
    try:
        anchor = int(token.strip())
    except ValueError as error:
        raise InvalidCursor("file cursor is not a number") from error
    if anchor < 1:
        raise InvalidCursor("file cursor must be positive")
    return anchor


def page_limit(limit: int | None, default_and_max: tuple[int, int] = PAGE_SIZE) -> int:
    """F8 for one request."""
    default, largest = default_and_max
    return default if limit is None else min(max(int(limit), 1), largest)


def page_limit_column(
    limit: Column | str, default_and_max: tuple[int, int] = PAGE_SIZE
) -> Column:
    """F8 on a column of requested sizes."""
    default, largest = default_and_max
    limit = col(limit)
    return F.when(limit.isNull(), F.lit(default)).otherwise(
        F.greatest(F.lit(1), F.least(limit, F.lit(largest)))
    )


def group_cursor(
    file_count: Column | str,
    total_size_bytes: Column | str,
    algorithm: Column | str,
    content_hash_hex: Column | str,
) -> Column:
    """the token for a group, as unpadded base64url of JSON with sorted keys."""
    payload = F.to_json(
        F.struct(
            col(content_hash_hex).alias("content_hash_hex"),
            col(file_count).alias("file_count"),
            col(algorithm).alias("hash_algorithm"),
            col(total_size_bytes).alias("total_size_bytes"),
        )
    )
    token = F.regexp_replace(F.base64(payload.cast("binary")), "[\r\n=]", "")
    return F.translate(token, "+/", "-_")


def parse_group_cursor(token: Column | str) -> Column:
    """the cursor's fields as a struct, NULL for anything that is not a valid cursor."""
    token = F.translate(strip(token), "-_", "+/")
    padded = F.concat(token, F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    fields = F.from_json(
        text,
        "content_hash_hex string, file_count bigint, hash_algorithm string, "
        "total_size_bytes bigint",
    )
    algorithm = F.lower(fields["hash_algorithm"])
    digest = F.lower(fields["content_hash_hex"])
    valid = (
        (fields["file_count"] >= 2)
        & (fields["total_size_bytes"] >= 0)
        & algorithm.isin(*HASH_ALGORITHMS)
        & digest.rlike(f"^[0-9a-f]{{{HEX_LENGTH}}}$")
    )
    return F.when(
        valid,
        F.struct(
            fields["file_count"].alias("file_count"),
            fields["total_size_bytes"].alias("total_size_bytes"),
            algorithm.alias("hash_algorithm"),
            digest.alias("content_hash_hex"),
        ),
    )


def parse_file_cursor(token: Column | str) -> Column:
    """the anchor id, NULL when the text is not an integer of at least 1."""
    anchor = strip(token).try_cast("bigint")
    return F.when(anchor >= 1, anchor)
