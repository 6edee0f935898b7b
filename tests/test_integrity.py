"""Names, repeated rows and size switches must not change what a scan means."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from samebytes.operators import merge, variants
from samebytes.operators.conform import conform
from samebytes.plans import catalog as jobs
from samebytes.sources import content, filetree
from samebytes.sources.store import SnapshotStore

NOW = "2026-01-01 00:00:00"


def test_names_are_told_apart():
    names = [b"a\xff", b"a\xfe", "a�".encode(), "a�FF".encode(), b"plain", "é".encode(), b"\x80\xff"]
    texts = [filetree.name_text(os.fsdecode(n)) for n in names]
    assert len(set(texts)) == len(names)
    assert [os.fsencode(filetree.name_on_disk(t)) for t in texts] == names
    assert all(t.encode("utf-8") for t in texts)


def test_colliding_names_stay_two_files(spark, tmp_path):
    library = os.fsencode(str(tmp_path / "root" / "lib"))
    os.makedirs(library + b"/d\xff")
    for name in (b"a\xff", b"a\xfe", b"d\xff/x"):
        with open(library + b"/" + name, "wb") as file:
            file.write(name)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    root = str(tmp_path / "root")
    for _ in range(3):
        assert jobs.run_scan(store, root, NOW).status == "succeeded"
    rows = store.read("library_files").collect()
    assert len(rows) == len({r.id for r in rows}) == 3
    jobs.run_hash(store, NOW, libraries_root=root)
    assert store.read("library_files").filter("content_hash IS NOT NULL").count() == 3
    store.retain("library_files", 1)
    assert store.read("library_files").count() == 3
    # A task that hands back a directory with such a name does not fail.
    assert filetree.walk_tree(spark, root, budget=1).filter("kind = 'file'").count() == 3


def test_repeated_and_stale_rows_give_the_same_catalog_either_way(spark):
    some = random.Random(5)
    columns = "library_id long, relative_path string, size_bytes long, mtime_ns long, inode long, device long"
    old = [(1, f"f{i}", i, i, i, 1) for i in range(40)]
    known = conform(spark.createDataFrame(old, columns).withColumn("id", F.col("inode") + 1), "library_files")
    seen = [(1, f"f{i}", i + some.randint(0, 1), i, i, 1) for i in range(20, 60)]
    scan = spark.createDataFrame(seen + seen[:10] + [(1, "f50", 999, 99, 1, 1)], columns)
    scanned = spark.createDataFrame([(1,)], "library_id long")
    ids = merge.assign_ids(known, scan)
    assert ids.count() == 20
    # Some new files lack an id, and some ids are of files that the catalog knows by now.
    partial = ids.filter("relative_path != 'f45'").unionByName(
        spark.createDataFrame([(1, "f30", 900)], "library_id long, relative_path string, id long")
    )
    both = [
        sorted(map(str, merge.merge_scan(known, scan, scanned, scan_id=7, now=NOW, new_ids=partial, small_rows=n).collect()))
        for n in (0, 200_000)
    ]
    assert both[0] == both[1] and len(both[0]) == 60
    row = merge.merge_scan(known, scan, scanned, scan_id=7, now=NOW, new_ids=ids).filter("relative_path = 'f50'").collect()
    assert [r.size_bytes for r in row] == [999]


@pytest.mark.parametrize("children", [300, 900])
def test_wide_directories_are_split(tmp_path, children):
    for i in range(children):
        os.makedirs(tmp_path / "lib" / f"d{i}")
    (tmp_path / "lib" / "d1" / "x").write_text("x")
    reader = filetree.FileTreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) >= 256
    entries = [e for p in parts for e in reader.read(p)]
    found = [e[2] for e in entries if e[1] == "directory"]
    assert len(found) == len(set(found)) == children + 1
    assert [e[2] for e in entries if e[1] == "file"] == ["d1/x"]


def test_hashing_stays_under_the_root(tmp_path):
    inside = tmp_path / "libs" / "a"
    inside.mkdir(parents=True)
    (inside / "f").write_bytes(b"x")
    info = (inside / "f").stat()
    expected = (info.st_size, info.st_mtime_ns)
    one = lambda root, path: content._hash_one(path, root, expected, "sha256", 10, str(tmp_path / "libs"))
    assert one(str(inside), str(inside / "f"))[0] == "hashed"
    assert one("/etc", "/etc/hostname")[0] == "failed"
    assert one(str(inside), str(inside) + "/\0")[0] == "failed"


def test_concurrency_gate_needs_no_window(spark):
    rows = [(i, "image" if i % 2 else "video", "pending") for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, media_type string, status string")
    table = frame.withColumns({
        "created_at": F.to_timestamp(F.lit(NOW)), "retry_after": F.lit(None).cast("timestamp"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
    })
    for limit in (3, 20_000):
        taken = variants.next_variants(table, "2026-01-02", {"image": limit, "video": 1})
        assert "row_number" not in taken._jdf.queryExecution().optimizedPlan().toString()
        assert taken.groupBy("media_type").count().collect() and taken.filter("media_type = 'image'").count() == min(limit, 20)
