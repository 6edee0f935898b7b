import os

import pytest

from samebytes.operators import duplicates
from samebytes.plans import catalog as plans
from samebytes.sources.store import SnapshotStore

NOW = ["2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-03 00:00:00"]


@pytest.fixture
def libraries(tmp_path):
    root = tmp_path / "libraries"
    for name in ("one", "two"):
        (root / name).mkdir(parents=True)
    (root / "one" / "a.jpg").write_bytes(b"same")
    (root / "one" / "b.jpg").write_bytes(b"same")
    (root / "two" / "c.mp4").write_bytes(b"same")
    (root / "two" / "d.txt").write_bytes(b"different")
    return root


def test_scan_hash_group_and_request(spark, tmp_path, libraries):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    session = plans.run_scan(store, str(libraries), NOW[0])
    assert (session.id, session.status, session.files_seen, session.bytes_seen) == (1, "succeeded", 4, 21)
    assert tuple(plans.run_hash(store, NOW[0], libraries_root=str(libraries))) == (4, 4, 0, 0, 0, 21)
    assert tuple(plans.run_hash(store, NOW[0], libraries_root=str(libraries))) == (0, 0, 0, 0, 0, 0)

    groups = plans.publish_groups(store)
    page = duplicates.list_groups(groups)
    assert [(g.file_count, g.duplicate_waste_bytes) for g in page.items] == [(3, 8)]
    roots = store.read("library_roots")
    files = duplicates.list_group_files(store.read("library_files"), roots, page.items[0].group_key)
    assert [(f.library_name, f.relative_path) for f in files.items] == [("one", "a.jpg"), ("one", "b.jpg"), ("two", "c.mp4")]
    assert {r.last_scanned_at is not None for r in roots.collect()} == {True}

    asked = spark.createDataFrame([(i, 1 + i % 4, None, None) for i in range(8)], "seq long, file_id long, max_dimension int, output_format string")
    outcome = plans.run_requests(store, asked, NOW[0], capacity=2, libraries_root=str(libraries))
    assert sorted((r.file_id, r.outcome, r.requests) for r in outcome.collect()) == [(1, "admitted", 2), (2, "admitted", 2), (3, "queue_full", 2), (4, "rejected", 2)]
    again = plans.run_requests(store, asked, NOW[0], capacity=9, libraries_root=str(libraries))
    assert sorted((r.file_id, r.outcome) for r in again.collect()) == [(1, "existing"), (2, "existing"), (3, "admitted"), (4, "rejected")]
    assert store.read("thumbnails").count() == 3

    # One file changes, one goes, one comes.
    (libraries / "one" / "b.jpg").write_bytes(b"changed")
    (libraries / "two" / "c.mp4").unlink()
    (libraries / "two" / "e.txt").write_bytes(b"same")
    plans.run_scan(store, str(libraries), NOW[1])
    after = {r.relative_path: r for r in store.read("library_files").collect()}
    assert {p: (r.id, r.is_missing, r.needs_hash) for p, r in after.items()} == {
        "a.jpg": (1, False, False), "b.jpg": (2, False, True), "c.mp4": (3, True, False), "d.txt": (4, False, False), "e.txt": (5, False, True),
    }
    assert after["c.mp4"].content_hash is not None and after["b.jpg"].content_hash is None
    assert plans.run_hash(store, NOW[1], max_files=1, libraries_root=str(libraries)).processed == 1
    assert plans.run_hash(store, NOW[1], libraries_root=str(libraries)).hashed == 1
    page = duplicates.list_groups(plans.publish_groups(store))
    assert [(g.file_count, g.sample_file_id) for g in page.items] == [(2, 1)]


def test_scan_with_errors_marks_nothing_missing(spark, tmp_path, libraries):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    plans.run_scan(store, str(libraries), NOW[0])
    (libraries / "two" / "d.txt").unlink()
    session = plans.run_scan(store, str(libraries), NOW[1], ["one", "two", "three"])
    assert (session.id, session.status, session.error_count) == (2, "failed", 1)
    assert session.error_message == "Scan encountered 1 filesystem access errors: /libraries/three: No such file or directory"
    assert store.read("library_files").filter("is_missing").count() == 0
    # A library that is not walked keeps its files, whatever happened to them.
    plans.run_scan(store, str(libraries), NOW[2], ["one"])
    assert store.read("library_files").filter("is_missing").count() == 0
    plans.run_scan(store, str(libraries), NOW[2], [" two ", "one", "one"])
    assert [r.relative_path for r in store.read("library_files").filter("is_missing").collect()] == ["d.txt"]


def test_file_that_changes_between_scan_and_hash_is_requeued(spark, tmp_path, libraries):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    plans.run_scan(store, str(libraries), NOW[0])
    (libraries / "one" / "a.jpg").write_bytes(b"longer than before")
    (libraries / "two" / "d.txt").unlink()
    counts = plans.run_hash(store, NOW[0], libraries_root=str(libraries))
    assert (counts.hashed, counts.requeued, counts.missing) == (2, 1, 1)
    assert plans.run_hash(store, NOW[0], libraries_root=str(libraries)).hashed == 1
    size = store.read("library_files").filter("relative_path = 'a.jpg'").first().size_bytes
    assert size == os.path.getsize(libraries / "one" / "a.jpg")


def test_bad_library_names_are_refused(spark, tmp_path, libraries):
    with pytest.raises(ValueError):
        plans.run_scan(SnapshotStore(spark, str(tmp_path / "store")), str(libraries), NOW[0], ["../one"])
