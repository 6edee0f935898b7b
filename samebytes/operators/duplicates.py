"""Duplicate groups, their members and their pages."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from samebytes.functions.cursors import (
    GroupCursor,
    decode_file_cursor,
    decode_group_cursor,
    encode_group_cursor,
    group_cursor,
    page_limit,
)
from samebytes.functions.hashes import group_key, hash_hex, read_group_key
from samebytes.functions.predicates import dedup_eligible
from samebytes.operators.scale import (
    TOP_K_ROWS,
    fits_broadcast,
    lookup_join,
    materialize,
    rows_asked_for,
    with_position,
)
from samebytes.schemas import CONTENT_TOTALS

HOT_GROUP_FILES = 1_000_000
CONTENT = ["hash_algorithm", "content_hash"]
#: Ranks of a folder of the published groups, cursors whose rank a listing remembers, and groups it reads at a time.
RANK_BLOCK, KNOWN_CURSORS, READ_AHEAD = 100_000, 10_000, 2_000


@dataclass(frozen=True)
class Page:
    """One page of a listing; at most the page limit of rows, so it may live on the driver."""

    items: list[Row]
    next_cursor: str | None


def content_totals(catalog: DataFrame) -> DataFrame:
    """Totals of every content that eligible files have, of a single file too.

    Grouping runs on the 32-byte digest; partial aggregation takes care of hot contents.
    """
    return (
        catalog.filter(dedup_eligible())
        .groupBy(*CONTENT)
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("size_bytes").alias("total_size_bytes"),
            F.min("size_bytes").alias("smallest_size_bytes"),
            F.min("id").alias("sample_file_id"),
        )
    )


def groups_of_totals(totals: DataFrame) -> DataFrame:
    """A1 from totals; text is built only for the groups that remain."""
    return totals.filter(F.col("file_count") > 1).select(
        group_key(*CONTENT).alias("group_key"),
        "hash_algorithm",
        hash_hex("content_hash").alias("content_hash_hex"),
        "content_hash",
        "file_count",
        "total_size_bytes",
        (F.col("total_size_bytes") - F.col("smallest_size_bytes")).alias("duplicate_waste_bytes"),
        "sample_file_id",
    )


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    """A1: one row per content that at least two eligible files share."""
    return groups_of_totals(content_totals(catalog))


def total_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change of the catalog does to the totals of each content it touches.

    Both sides are the same part of the catalog. A file that had another content, had none or goes
    missing counts against its old content and for its new one; untouched files do not count.
    """
    slim = lambda side, name: side.filter(dedup_eligible()).select(
        "id", F.struct(*CONTENT, "size_bytes").alias(name)
    )
    both = slim(before, "old").join(slim(after, "new"), "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    sides = F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("file")),
        F.struct(F.lit(1).alias("sign"), F.col("new").alias("file")),
    ))
    rows = both.select("id", sides.alias("s")).filter("s.file IS NOT NULL").select("id", "s.sign", "s.file.*")
    gone = F.col("sign") < 0
    return rows.groupBy(*CONTENT).agg(
        F.sum("sign").alias("files"),
        F.sum(F.col("sign") * F.col("size_bytes")).alias("bytes"),
        F.min(F.when(gone, F.col("size_bytes"))).alias("gone_size"),
        F.min(F.when(gone, F.col("id"))).alias("gone_id"),
        F.min(F.when(~gone, F.col("size_bytes"))).alias("new_size"),
        F.min(F.when(~gone, F.col("id"))).alias("new_id"),
    )


def apply_changes(totals: DataFrame, changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Totals after a change: counts and sums are carried on, contents without files go.

    `totals` is the part that `changes` fall into. A smallest size or first id can only be lost where
    a file that went had it; the files of those contents alone are looked up in the new catalog.
    """
    zero = F.lit(0).cast("bigint")
    joined = totals.join(changes, CONTENT, "full_outer").select(
        *CONTENT,
        (F.coalesce("file_count", zero) + F.coalesce("files", zero)).alias("file_count"),
        (F.coalesce("total_size_bytes", zero) + F.coalesce("bytes", zero)).alias("total_size_bytes"),
        F.least("smallest_size_bytes", "new_size").alias("smallest_size_bytes"),
        F.least("sample_file_id", "new_id").alias("sample_file_id"),
        F.coalesce(
            (F.col("gone_size") <= F.col("smallest_size_bytes")) | (F.col("gone_id") <= F.col("sample_file_id")), F.lit(False)
        ).alias("lost"),
    )
    kept = materialize(joined.filter("file_count > 0"))
    lost = kept.filter("lost").select(*CONTENT)
    files = catalog.filter(dedup_eligible())
    asked = rows_asked_for(files, lost) if fits_broadcast(lost) else files.join(lost, CONTENT, "left_semi")
    found = asked.groupBy(*CONTENT).agg(F.min("size_bytes").alias("_size"), F.min("id").alias("_id"))
    mended = kept.filter("lost").join(found, CONTENT).withColumns(
        {"smallest_size_bytes": F.col("_size"), "sample_file_id": F.col("_id")}
    )
    columns = CONTENT_TOTALS.fieldNames()
    return kept.filter("NOT lost").select(*columns).unionByName(mended.select(*columns))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """A2: number of groups, files in them and bytes that copies waste."""
    return groups.agg(
        F.count(F.lit(1)).alias("group_count"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum("duplicate_waste_bytes"), F.lit(0)).alias("duplicate_waste_bytes"),
    )


def group_order() -> list[Column]:
    """Most files first, then most bytes, then by hash."""
    return [
        F.desc("file_count"),
        F.desc("total_size_bytes"),
        F.asc("hash_algorithm"),
        F.asc("content_hash_hex"),
    ]


def _after(cursor: GroupCursor) -> Column:
    """Rows behind a cursor, in comparisons of plain columns that a scan can use."""
    files, total = F.col("file_count"), F.col("total_size_bytes")
    algorithm, digest = F.col("hash_algorithm"), F.col("content_hash_hex")
    later = digest > cursor.content_hash_hex
    later = (algorithm > cursor.hash_algorithm) | ((algorithm == cursor.hash_algorithm) & later)
    later = (total < cursor.total_size_bytes) | ((total == cursor.total_size_bytes) & later)
    return (files < cursor.file_count) | ((files == cursor.file_count) & later)


def group_page(groups: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """The groups after the cursor, in order, with the cursor that continues after each."""
    if cursor:
        groups = groups.filter(_after(decode_group_cursor(cursor)))
    page = groups.orderBy(*group_order()).limit(page_limit(limit))
    return page.withColumn("cursor", group_cursor(*GroupCursor._fields))


def list_groups(groups: DataFrame, limit: int | None = None, cursor: str | None = None) -> Page:
    """T1 as a request: items and the cursor of the next page, if there is one.

    To page through many groups, publish `duplicate_groups` once and list from that table.
    """
    size = page_limit(limit)
    if cursor:
        groups = groups.filter(_after(decode_group_cursor(cursor)))
    rows = groups.drop("content_hash").orderBy(*group_order()).limit(size + 1).collect()
    return Page(rows[:size], _token(rows[size - 1]) if len(rows) > size else None)


def _token(row: Row) -> str:
    return encode_group_cursor(GroupCursor(*(row[name] for name in GroupCursor._fields)))


def group_pages(
    groups: DataFrame, limit: int | None = None, ahead: int | None = None
) -> Iterator[Page]:
    """T1 for a whole traversal: the pages `list_groups` would give, `ahead` of them per job.

    The driver holds no more than these; by default they have about 10,000 rows.
    """
    size = page_limit(limit)
    ahead = max(1, TOP_K_ROWS // size) if ahead is None else ahead
    names = [c for c in groups.columns if c != "content_hash"]
    cursor = None
    while True:
        after = groups if cursor is None else groups.filter(_after(decode_group_cursor(cursor)))
        rows = after.select(*names).orderBy(*group_order()).limit(ahead * size + 1).collect()
        for start in range(0, min(max(len(rows), 1), ahead * size), size):
            more = len(rows) > start + size
            last = rows[start + size - 1] if more else None
            cursor = _token(last) if last else None
            yield Page(rows[start : start + size], cursor)
        if cursor is None:
            return


def ranked_groups(groups: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """Groups with their place in the listing (`rank`) and the `rank_block` it falls into."""
    placed = numbered_pages(groups, block)
    return placed.withColumnRenamed("page", "rank_block").select(*groups.columns, "rank", "rank_block")


def ranked_range(ranked: DataFrame, start: int, count: int, block: int = RANK_BLOCK) -> DataFrame:
    """Groups of some ranks, in any order. Nothing is sorted, and other blocks are not read."""
    last = start + count - 1
    blocks = F.col("rank_block").between(start // block, last // block)
    return ranked.filter(blocks & F.col("rank").between(start, last))


class GroupListing:
    """T1 over published groups that carry their rank: a page is a range of ranks.

    The listing remembers the rank behind the cursors that it handed out last. Any other cursor is
    placed by one aggregation over the rows behind it, of which the scan reads one column. A read takes
    at least `ahead` groups, from which the pages that follow are served; published groups do not change.
    """

    def __init__(self, ranked: DataFrame, block: int = RANK_BLOCK, ahead: int = READ_AHEAD):
        self.block, self.ahead = block, ahead
        self._first, self._rows, self._end = 0, [], False
        self.ranked = ranked.drop("content_hash")
        self.columns = [c for c in self.ranked.columns if c not in ("rank", "rank_block")]
        self._places: OrderedDict[str, int] = OrderedDict()

    def _place(self, token: str) -> int | None:
        """Rank of the first group behind a cursor; None if there is none."""
        cursor = decode_group_cursor(token)
        known = self._places.get(encode_group_cursor(cursor))
        if known is not None:
            return known
        return self.ranked.filter(_after(cursor)).agg(F.min("rank")).first()[0]

    def _range(self, start: int, count: int) -> list[Row]:
        """Groups of some ranks in order; the driver holds no more than the larger of a page and `ahead`."""
        at = start - self._first
        if at < 0 or (at + count > len(self._rows) and not self._end):
            asked = max(count, self.ahead)
            rows = ranked_range(self.ranked, start, asked, self.block).select("rank", *self.columns).collect()
            rows.sort(key=lambda row: row["rank"])
            self._first, self._rows, self._end, at = start, rows, len(rows) < asked, 0
        return self._rows[at : at + count]

    def page(self, limit: int | None = None, cursor: str | None = None) -> Page:
        """The same page that `list_groups` gives."""
        size = page_limit(limit)
        start = self._place(cursor) if cursor else 0
        if start is None:
            return Page([], None)
        found = self._range(start, size + 1)
        items = [Row(*self.columns)(*row[1:]) for row in found[:size]]
        if len(found) <= size:
            return Page(items, None)
        token = _token(items[-1])
        self._places[token] = start + size
        while len(self._places) > KNOWN_CURSORS:
            self._places.popitem(last=False)
        return Page(items, token)


MEMBER_COLUMNS = (
    "file_id",
    "library_id",
    "library_name",
    "relative_path",
    "size_bytes",
    "mtime_ns",
    "hashed_at",
)


def _with_library(files: DataFrame, roots: DataFrame) -> DataFrame:
    names = roots.select(F.col("id").alias("library_id"), F.col("name").alias("library_name"))
    return lookup_join(files.withColumnRenamed("id", "file_id"), names, "library_id")


def group_members(
    catalog: DataFrame,
    roots: DataFrame,
    groups: DataFrame,
    hot_files: int = HOT_GROUP_FILES,
) -> DataFrame:
    """J3 for every group at once: each eligible file of a duplicate group, with its library.

    Group sizes are known, so groups of at least `hot_files` files take a path of their own:
    a catalog of N files has at most N / hot_files of them, few enough to be looked up
    without shuffling their members. All other groups are small and join by shuffle.
    """
    keys = ["hash_algorithm", "content_hash"]
    files = catalog.filter(dedup_eligible())
    wanted = materialize(groups.select(*keys, "file_count"))
    is_hot = F.col("file_count") >= hot_files
    hot = wanted.filter(is_hot).drop("file_count")
    cold = wanted.filter(~is_hot).drop("file_count")
    if hot.isEmpty():
        members = files.join(cold, keys)
    else:
        rest = lookup_join(files, hot.select(*keys), keys, "left_anti")
        members = lookup_join(files, hot, keys).unionByName(rest.join(cold, keys))
    members = members.withColumn("group_key", group_key(*keys))
    return _with_library(members, roots).select("group_key", *MEMBER_COLUMNS)


def _files_of(catalog: DataFrame, roots: DataFrame, key: str, cursor: str | None) -> DataFrame:
    algorithm, digest = read_group_key(key)
    files = catalog.filter(
        ~F.col("is_missing")
        & ~F.col("needs_hash")
        & (F.col("hash_algorithm") == algorithm)
        & (F.col("content_hash") == F.lit(digest))
    )
    anchor = decode_file_cursor(cursor)
    if anchor is not None:
        files = files.filter(F.col("id") > anchor)
    return _with_library(files, roots).select(*MEMBER_COLUMNS)


def group_file_page(
    catalog: DataFrame,
    roots: DataFrame,
    key: str,
    limit: int | None = None,
    cursor: str | None = None,
) -> DataFrame:
    """Files of one group after the cursor, by id. The hash filter reaches the scan."""
    files = _files_of(catalog, roots, key, cursor)
    return files.orderBy("file_id").limit(page_limit(limit))


def list_group_files(
    catalog: DataFrame,
    roots: DataFrame,
    key: str,
    limit: int | None = None,
    cursor: str | None = None,
) -> Page:
    """T2 as a request."""
    size = page_limit(limit)
    rows = _files_of(catalog, roots, key, cursor).orderBy("file_id").limit(size + 1).collect()
    more = len(rows) > size
    return Page(rows[:size], str(rows[size - 1].file_id) if more else None)


def numbered_pages(groups: DataFrame, page_size: int) -> DataFrame:
    """The whole traversal at once; `page` and `rank` start at 0.

    Digests are ranked as bytes, which sort like their hex text; the text is added afterwards.
    """
    *sizes, _ = group_order()
    slim = groups.drop("group_key", "content_hash_hex")
    placed = with_position(slim, [*sizes, F.asc("content_hash")], "rank")
    return placed.select(
        group_key("hash_algorithm", "content_hash").alias("group_key"),
        hash_hex("content_hash").alias("content_hash_hex"),
        *placed.columns,
        F.call_function("div", F.col("rank"), F.lit(page_size)).alias("page"),
    )
