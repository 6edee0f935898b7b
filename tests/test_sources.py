import os

import pytest
from pyspark.sql import functions as F

from samebytes.operators.conform import conform
from samebytes.operators.hashing import hash_summary
from samebytes.sources import content, filetree
from samebytes.sources.store import SnapshotStore


@pytest.fixture
def tree(tmp_path):
    """Two libraries with everything a walk has to cope with, and things beside them."""
    root = tmp_path / "libs"
    media = root / "media"
    (media / "sub" / ".hidden").mkdir(parents=True)
    (root / "other" / "deep" / "er").mkdir(parents=True)
    (media / "a.bin").write_bytes(b"one")
    (media / ".dot").write_bytes(b"dot")
    (media / "_under").write_bytes(b"under")
    (media / "empty").write_bytes(b"")
    (media / "sub" / ".hidden" / "x").write_bytes(b"x")
    os.link(media / "a.bin", media / "hard.bin")
    os.symlink(media / "a.bin", media / "link.bin")
    os.symlink(media / "sub", media / "linkdir")
    os.mkfifo(media / "pipe")
    (root / "other" / "deep" / "er" / "y").write_bytes(b"y" * 10)
    (root / "file-not-library").write_bytes(b"z")
    os.symlink(root / "other", root / "linked-library")
    with open(os.fsencode(str(media)) + b"/bad-\xff", "wb") as file:
        file.write(b"b")
    return str(root)


FILES = {
    ("media", ".dot"), ("media", "_under"), ("media", "a.bin"), ("media", "hard.bin"), ("media", "empty"),
    ("media", "bad-�FF"), ("media", "sub/.hidden/x"), ("other", "deep/er/y"),
}
DIRECTORIES = {("media", ""), ("media", "sub"), ("media", "sub/.hidden"), ("other", ""), ("other", "deep"), ("other", "deep/er")}


def entries(df, kind):
    rows = [(r.library, r.relative_path) for r in df.filter(F.col("kind") == kind).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("splits", [1, 2, 3, 100])
def test_data_source_lists_files(spark, tree, splits):
    df = filetree.read_tree(spark, tree, splits=splits)
    assert entries(df, "file") == FILES
    assert entries(df, "directory") == DIRECTORIES
    assert entries(df, "error") == set()


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_walk_lists_files_in_rounds(spark, tree, budget):
    df = filetree.walk_tree(spark, tree, budget=budget)
    assert entries(df, "file") == FILES
    assert entries(df, "directory") == DIRECTORIES


def test_stat_fields(spark, tree):
    row = filetree.read_tree(spark, tree, ["media"]).filter("relative_path = 'a.bin'").first()
    info = os.stat(os.path.join(tree, "media", "a.bin"))
    assert (row.size_bytes, row.mtime_ns, row.inode, row.device) == (3, info.st_mtime_ns, info.st_ino, info.st_dev)


def test_unreadable_library_is_an_error_row(spark, tree):
    for df in (filetree.read_tree(spark, tree, ["gone", "other"]), filetree.walk_tree(spark, tree, ["gone", "other"])):
        assert entries(df, "error") == {("gone", "")}
        assert ("other", "deep/er/y") in entries(df, "file")


def test_library_that_is_a_link_is_an_error_row(spark, tree):
    df = filetree.walk_tree(spark, tree, ["linked-library"])
    assert entries(df, "error") == {("linked-library", "")} and entries(df, "file") == set()


def test_directory_that_appears_after_planning_is_walked(tree):
    reader = filetree.FileTreeReader({"path": tree, "splits": "50"})
    parts = reader.partitions()
    late = os.path.join(tree, "media", "late")
    os.mkdir(late)
    open(os.path.join(late, "f"), "w").close()
    found = {(e[0], e[2]) for part in parts for e in reader.read(part) if e[1] == "file"}
    assert found == FILES | {("media", "late/f")}


def candidate_frame(spark, rows):
    return spark.createDataFrame(
        rows, "id long, relative_path string, expected_size long, expected_mtime_ns long, hash_error_count int, root_path string"
    )


def test_hash_outcomes(spark, tmp_path):
    import hashlib

    root = tmp_path / "lib"
    root.mkdir()
    data = os.urandom(100_000)
    (root / "ok").write_bytes(data)
    (root / "changed").write_bytes(b"abc")
    (root / "folder").mkdir()
    (tmp_path / "secret").write_bytes(b"s")
    os.symlink(tmp_path / "secret", root / "escape")
    when = lambda name: os.stat(root / name).st_mtime_ns
    rows = [
        (1, "ok", len(data), when("ok"), 0, str(root)),
        (2, "changed", 99, when("changed"), 0, str(root)),
        (3, "changed", 3, 1, 0, str(root)),
        (4, "absent", 1, 1, 0, str(root)),
        (5, "folder", 1, 1, 0, str(root)),
        (6, "escape", 1, 1, 0, str(root)),
        (7, "ok", 1, 1, 0, str(tmp_path / "no-root")),
    ]
    outcomes = content.hash_files(candidate_frame(spark, rows), chunk_bytes=1000, libraries_root=None).cache()
    got = {r.id: r for r in outcomes.collect()}
    assert [got[i].outcome for i in range(1, 8)] == ["hashed", "requeued", "requeued", "missing", "missing", "failed", "failed"]
    assert bytes(got[1].digest) == hashlib.sha256(data).digest()
    assert (got[1].bytes_hashed, got[2].size_bytes, got[3].mtime_ns) == (len(data), 3, when("changed"))
    assert "escapes" in got[6].error
    assert tuple(hash_summary(outcomes).first()) == (7, 1, 2, 2, 2, len(data))
    outcomes.unpersist()


def test_reading_is_split_by_bytes(spark, tmp_path):
    rows = [(i, "x", 1_000_000, 1, 0, str(tmp_path)) for i in range(50)]
    assert content.hash_files(candidate_frame(spark, rows), bytes_per_task=1_000_000).rdd.getNumPartitions() == 51


def test_unknown_algorithms_are_refused(spark):
    with pytest.raises(ValueError):
        content.hash_files(candidate_frame(spark, []), algorithm="md5")


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.current_version("thing") == 0
    assert store.read("library_files").count() == 0
    with pytest.raises(LookupError):
        store.read("thing")
    assert store.publish("thing", spark.range(3)) == 1
    reader = store.read("thing")
    # A reader of the old version is not disturbed by a new one made from it.
    assert store.publish("thing", reader.filter("id > 0"), cluster_by=["id"]) == 2
    assert (reader.count(), store.read("thing").count(), store.read("thing", 1).count()) == (3, 2, 3)


def _files(spark, *rows):
    columns = "id long, library_id long, relative_path string, size_bytes long, mtime_ns long"
    return conform(spark.createDataFrame(rows, columns), "library_files")


def _parquet(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_small_change_writes_one_bucket(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=8)
    assert store.touched("library_files", _files(spark)) is None
    rows = [(i, i % 3, f"f{i}", i, i) for i in range(1, 101)]
    store.publish("library_files", _files(spark, *rows), cluster_by=["id"])
    before, old = _parquet(tmp_path), store.read("library_files")
    assert len(before) == 8 and store.top_id("library_files") == 100

    changed = _files(spark, (7, 1, "f7", 700, 7), (101, 1, "f7b", 1, 1))
    touched = store.touched("library_files", changed.limit(1))
    assert len(touched) == 1
    part = store.read("library_files", buckets=touched)
    assert 0 < part.count() < 40
    after = part.filter("id != 7").unionByName(changed.limit(1))
    assert store.replace("library_files", after, touched) == 2
    assert len(_parquet(tmp_path) - before) == 1 and before <= _parquet(tmp_path)
    assert old.filter("id = 7").first().size_bytes == 7  # readers of the old version are not disturbed
    assert store.read("library_files", 1).agg({"size_bytes": "sum"}).first()[0] == 5050
    assert store.read("library_files").agg({"size_bytes": "sum"}).first()[0] == 5050 + 693
    assert store.read("library_files").schema == old.schema

    # A bucket may lose all its rows, and a whole version starts anew.
    store.replace("library_files", after.limit(0), touched)
    assert store.read("library_files").count() == 100 - part.count()
    store.publish("library_files", _files(spark, *rows[:5]))
    assert (store.read("library_files").count(), store.read("library_files", 2).count(), store.top_id("library_files")) == (5, 100, 5)


def test_retained_versions_keep_folders_of_older_ones(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    store.publish("library_files", _files(spark, *[(i, 1, f"f{i}", 1, 1) for i in range(1, 41)]))
    for size in (2, 3, 4):
        one = _files(spark, (1, 1, "f1", size, 1))
        touched = store.touched("library_files", one)
        rest = store.read("library_files", buckets=touched).filter("id != 1")
        store.replace("library_files", rest.unionByName(one), touched)
    store.retain("library_files", 2)
    assert len(_parquet(tmp_path)) == 3 + 2
    assert [store.read("library_files", v).agg({"size_bytes": "sum"}).first()[0] for v in (3, 4)] == [42, 43]


def test_whole_tables_of_older_stores_get_buckets(spark, tmp_path):
    rows = [(i, 1, f"f{i}", 1, 1) for i in range(1, 11)]
    SnapshotStore(spark, str(tmp_path / "store"), buckets=0).publish("library_files", _files(spark, *rows))
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.touched("library_files", _files(spark, rows[0])) is None
    assert store.read("library_files").count() == 10 and store.top_id("library_files") == 10
    store.replace("library_files", store.read("library_files"), None)
    assert len(store.touched("library_files", _files(spark, rows[0]))) == 1


def test_a_stream_batch_leaves_other_buckets_alone(spark, tmp_path):
    from samebytes.streaming import incremental

    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=16)
    store.publish("library_files", _files(spark, *[(i, 1, f"f{i}", 1, 1) for i in range(1, 201)]))
    before = _parquet(tmp_path / "store" / "library_files")
    scan = "library_id long, relative_path string, size_bytes long, mtime_ns long, inode long, device long"
    spark.createDataFrame([(1, "f7", 9, 9, None, None), (1, "new", 5, 5, None, None)], scan).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scan).parquet(str(tmp_path / "in"))
    incremental.merge_stream(stream, store, str(tmp_path / "ckpt"), scan_id=3, now="2026-01-01").awaitTermination()
    fresh = _parquet(tmp_path / "store" / "library_files") - before
    assert 1 <= len(fresh) <= 2
    rows = {r.relative_path: (r.id, r.size_bytes) for r in store.read("library_files").collect()}
    assert len(rows) == 201 and rows["f7"] == (7, 9) and rows["new"] == (201, 5)


def test_filters_save_reading_directories(tree, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    scan, read = os.scandir, []
    monkeypatch.setattr(os, "scandir", lambda path: (read.append(os.path.relpath(path, tree)), scan(path))[1])

    def rows(*filters):
        reader = filetree.FileTreeReader({"path": str(tree)})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        read.clear()
        return [row for part in reader.partitions() for row in reader.read(part)]

    everything = rows()
    assert len(set(read)) > 5
    top = rows(EqualTo(("kind",), "directory"), EqualTo(("relative_path",), ""))
    assert sorted(top) == sorted(r for r in everything if r[1:3] == ("directory", "")) and read == ["."]
    other = rows(EqualTo(("library",), "other"))
    assert sorted(other) == sorted(r for r in everything if r[0] == "other") and not any(p.startswith("media") for p in read)
    assert rows(In(("library",), ("other", "none")), EqualTo(("library",), "none")) == []
    below = [r for r in rows(StringStartsWith(("relative_path",), "sub/.h")) if r[2].startswith("sub/.h")]
    assert below == [r for r in everything if r[2].startswith("sub/.h")] and "media" not in read
    assert [r for r in rows(EqualTo(("relative_path",), "")) if r[1] == "error"] == [r for r in everything if r[1:3] == ("error", "")]


def test_pushed_filters_give_the_same_rows(spark, tree):
    entries = filetree.read_tree(spark, str(tree))
    everything = [tuple(r) for r in entries.collect()]
    tests = {
        "kind = 'directory' AND relative_path = ''": lambda r: r[1] == "directory" and r[2] == "",
        "library = 'other'": lambda r: r[0] == "other",
        "relative_path LIKE 'sub/%' AND library IN ('media', 'x')": lambda r: r[2].startswith("sub/") and r[0] == "media",
        "relative_path LIKE 'deep/er/%'": lambda r: r[2].startswith("deep/er/"),
        "relative_path = ''": lambda r: r[2] == "",
    }
    for text, wanted in tests.items():
        assert sorted(map(repr, map(tuple, entries.filter(text).collect()))) == sorted(repr(r) for r in everything if wanted(r)), text
