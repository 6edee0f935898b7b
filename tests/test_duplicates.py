import random

import pytest
from pyspark.sql import functions as F

from samebytes.functions.cursors import (
    GroupCursor,
    InvalidCursor,
    decode_file_cursor,
    decode_group_cursor,
    encode_group_cursor,
    page_limit,
)
from samebytes.operators import duplicates
from samebytes.operators.conform import conform

COLUMNS = "id long, library_id long, relative_path string, size_bytes long, mtime_ns long, hash_algorithm string, content_hash binary, is_missing boolean, needs_hash boolean"


def catalog(spark, groups):
    """(algorithm, byte, size, count, is_missing, needs_hash) per group of equal files."""
    rows, number = [], 0
    for algorithm, byte, size, count, missing, pending in groups:
        for _ in range(count):
            number += 1
            rows.append((number, 1, f"f{number}", size, 1, algorithm, bytes([byte]) * 32, missing, pending))
    return conform(spark.createDataFrame(rows, COLUMNS), "library_files")


@pytest.fixture
def roots(spark):
    return spark.createDataFrame([(1, "media", "/libraries/media")], "id long, name string, root_path string")


def test_groups_are_paged_by_size(spark):
    files = catalog(
        spark,
        [
            ("sha256", 0x11, 100, 3, False, False),
            ("blake3", 0x22, 200, 2, False, False),
            ("sha256", 0x33, 500, 1, False, False),
            ("sha256", 0x11, 100, 1, True, False),
            ("sha256", 0x11, 100, 1, False, True),
        ],
    )
    groups = duplicates.duplicate_groups(files)
    first = duplicates.list_groups(groups, 1)
    assert [(r.file_count, r.total_size_bytes, r.duplicate_waste_bytes) for r in first.items] == [(3, 300, 200)]
    assert first.items[0].group_key == "sha256:" + "11" * 32
    assert first.items[0].sample_file_id == 1
    second = duplicates.list_groups(groups, 1, first.next_cursor)
    assert [(r.file_count, r.total_size_bytes, r.duplicate_waste_bytes) for r in second.items] == [(2, 400, 200)]
    assert second.next_cursor is None


def test_equal_bytes_under_different_algorithms_stay_apart(spark):
    files = catalog(spark, [("sha256", 0x11, 9, 1, False, False), ("blake3", 0x11, 9, 1, False, False)])
    assert duplicates.duplicate_groups(files).count() == 0


def test_full_traversal_has_no_gaps_and_no_repeats(spark):
    files = catalog(spark, [("sha256", i, 10 * (i % 3), 2 + i % 2, False, False) for i in range(40)])
    groups = duplicates.duplicate_groups(files).cache()
    expected = [r.group_key for r in groups.orderBy(*duplicates.group_order()).collect()]
    seen, cursor = [], None
    while True:
        page = duplicates.list_groups(groups, 7, cursor)
        seen += [r.group_key for r in page.items]
        if (cursor := page.next_cursor) is None:
            break
    assert seen == expected and len(seen) == 40
    single = duplicates.list_groups(groups, 7)
    for size, ahead in ((7, 1), (7, 3), (8, 5), (40, 2), (13, 10), (6, None)):
        pages = list(duplicates.group_pages(groups, size, ahead))
        assert [r.group_key for p in pages for r in p.items] == expected
        assert [len(p.items) for p in pages] == [size] * (40 // size) + [40 % size] * (40 % size > 0)
        assert pages[-1].next_cursor is None
        assert size != 7 or pages[0] == single
    assert [p.items for p in duplicates.group_pages(groups.limit(0))] == [[]]
    numbered = duplicates.numbered_pages(groups, 7).orderBy("rank").collect()
    assert [r.group_key for r in numbered] == expected
    assert [r.page for r in numbered] == [i // 7 for i in range(40)]
    groups.unpersist()


def test_files_without_bytes_are_a_group_that_can_be_paged(spark):
    files = catalog(spark, [("sha256", i, 0, 2, False, False) for i in range(3)])
    groups = duplicates.duplicate_groups(files)
    first = duplicates.list_groups(groups, 2)
    assert len(duplicates.list_groups(groups, 2, first.next_cursor).items) == 1


@pytest.mark.parametrize(
    "token",
    [
        "invalid-cursor",
        "",
        encode_group_cursor(GroupCursor(3, 300, "sha256", "aa")),
        encode_group_cursor(GroupCursor(1, 300, "sha256", "aa" * 32)),
        encode_group_cursor(GroupCursor(3, -1, "sha256", "aa" * 32)),
        encode_group_cursor(GroupCursor(3, 300, "md5", "aa" * 32)),
        encode_group_cursor(GroupCursor(3, 300, "sha256", "zz" * 32)),
    ],
)
def test_bad_group_cursors_are_rejected(token):
    with pytest.raises(InvalidCursor):
        decode_group_cursor(token)


def test_cursor_text_is_canonical():
    cursor = GroupCursor(3, 300, "sha256", "ab" * 32)
    token = encode_group_cursor(cursor)
    assert "=" not in token and decode_group_cursor(token) == cursor
    assert token.startswith("eyJjb250ZW50X2hhc2hfaGV4Ijoi")


def test_group_files_are_paged_by_id(spark, roots):
    files = catalog(spark, [("sha256", 0x44, 128, 5, False, False), ("sha256", 0x45, 1, 2, False, False)])
    key = "SHA256:" + "44" * 32
    seen, cursor, pages = [], None, 0
    while True:
        page = duplicates.list_group_files(files, roots, key, 2, cursor)
        seen, pages = seen + [r.file_id for r in page.items], pages + 1
        assert {r.library_name for r in page.items} == {"media"}
        if (cursor := page.next_cursor) is None:
            break
    assert (seen, pages) == ([1, 2, 3, 4, 5], 3)


@pytest.mark.parametrize("key", ["invalid", "sha256:abcd", "", "md5:" + "aa" * 32, "sha256:" + "zz" * 32])
def test_bad_group_keys_are_rejected(spark, roots, key):
    with pytest.raises(ValueError):
        duplicates.list_group_files(catalog(spark, []), roots, key)


@pytest.mark.parametrize("token", ["", "x", "0", "-3", "1.5"])
def test_bad_file_cursors_are_rejected(token):
    with pytest.raises(InvalidCursor):
        decode_file_cursor(token)


def test_page_limits():
    assert [page_limit(n) for n in (None, -4, 0, 7, 5000)] == [100, 1, 1, 7, 1000]


@pytest.mark.parametrize("hot_files", [1, 3, 100])
def test_members_do_not_depend_on_what_is_hot(spark, roots, hot_files):
    files = catalog(
        spark,
        [("sha256", 1, 5, 30, False, False), ("sha256", 2, 5, 2, False, False), ("sha256", 3, 5, 1, False, False)],
    )
    groups = duplicates.duplicate_groups(files)
    members = duplicates.group_members(files, roots, groups, hot_files=hot_files)
    assert sorted(r.file_id for r in members.collect()) == list(range(1, 33))


def test_grouping_stays_in_the_jvm_and_shuffles_once(spark):
    files = catalog(spark, [("sha256", i, 100 + i, 3, False, False) for i in range(20)])
    page = duplicates.group_page(duplicates.duplicate_groups(files), 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_group_lookup_reaches_the_scan(spark, roots, tmp_path, settings):
    path = str(tmp_path / "files")
    catalog(spark, [("sha256", i, 1, 2, False, False) for i in range(9)]).write.parquet(path)
    page = duplicates.group_file_page(spark.read.parquet(path), roots, "sha256:" + "03" * 32, 5, "1")
    with settings(spark__sql__maxMetadataStringLength="5000"):
        plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(content_hash" in plan and "EqualTo(hash_algorithm,sha256)" in plan
    assert "GreaterThan(id,1)" in plan
    assert "hashed_size_bytes" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [r.file_id for r in page.collect()] == [7, 8]


def test_totals_of_nothing(spark):
    totals = duplicates.duplicate_totals(duplicates.duplicate_groups(catalog(spark, []))).first()
    assert tuple(totals) == (0, 0, 0)


def test_waste_is_everything_but_the_smallest_copy(spark):
    files = catalog(spark, [("sha256", 1, 10, 1, False, False), ("sha256", 1, 14, 2, False, False)])
    row = duplicates.duplicate_groups(files).select(F.col("duplicate_waste_bytes")).first()
    assert row[0] == 38 - 10


def test_cursor_reaches_the_scan_in_all_plain_columns(spark, tmp_path, settings):
    rows = [(f"sha256:{i:064x}", "sha256", f"{i:064x}", bytes(32), 2, 10, 5, i) for i in range(40)]
    columns = "group_key string, hash_algorithm string, content_hash_hex string, content_hash binary, file_count long, total_size_bytes long, duplicate_waste_bytes long, sample_file_id long"
    groups = spark.createDataFrame(rows, columns)
    groups.write.parquet(f"{tmp_path}/plain")
    cursor = duplicates.list_groups(groups, 5).next_cursor
    with settings(spark__sql__maxMetadataStringLength="2000"):
        page = duplicates.group_page(spark.read.parquet(f"{tmp_path}/plain"), 5, cursor)
        plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    for name in ("LessThan(file_count", "LessThan(total_size_bytes", "GreaterThan(hash_algorithm", "GreaterThan(content_hash_hex"):
        assert name in pushed


def test_ranked_listing_equals_keyset_pages(spark, tmp_path):
    some = random.Random(11)
    files = []
    for group in range(60):
        for copy in range(some.randint(1, 4)):
            files.append((len(files) + 1, 1, f"f{len(files)}", some.choice([5, 9]), False, False, some.choice(["sha256", "blake3"]) if group % 9 == 0 else "sha256", bytes([group]) * 32))
    columns = "id long, library_id long, relative_path string, size_bytes long, is_missing boolean, needs_hash boolean, hash_algorithm string, content_hash binary"
    groups = duplicates.duplicate_groups(spark.createDataFrame(files, columns))
    ranked = duplicates.ranked_groups(groups, block=7)
    ranked.write.partitionBy("rank_block").parquet(f"{tmp_path}/ranked")
    ranked = spark.read.parquet(f"{tmp_path}/ranked")
    plan = duplicates.ranked_range(ranked, 10, 6, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan
    assert "GreaterThanOrEqual(rank,10)" in plan and "PartitionFilters: [isnotnull(rank_block" in plan

    listing, cursor, seen = duplicates.GroupListing(ranked, 7, ahead=20), None, []
    while True:
        page = listing.page(8, cursor)
        assert page == duplicates.list_groups(groups, 8, cursor) == duplicates.GroupListing(ranked, 7, ahead=1).page(8, cursor)
        seen += page.items
        cursor = page.next_cursor
        if cursor is None:
            break
    everything = duplicates.numbered_pages(groups, 8).orderBy("rank").collect()
    assert [r.group_key for r in seen] == [r.group_key for r in everything]
    # A cursor whose group is gone still has its place.
    gone = duplicates.GroupListing(ranked.filter("rank != 7"), 7)
    first = listing.page(8)
    assert [r.group_key for r in gone.page(8, first.next_cursor).items] == [r.group_key for r in listing.page(8, first.next_cursor).items]
    end = duplicates.encode_group_cursor(duplicates.GroupCursor(2, 0, "sha256", "f" * 64))
    assert listing.page(8, end) == duplicates.Page([], None)
