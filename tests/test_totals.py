"""Totals carried on from change to change against totals of the whole catalog."""

import random

from samebytes.operators.conform import conform
from samebytes.operators.duplicates import (
    apply_changes,
    content_totals,
    duplicate_groups,
    groups_of_totals,
    total_changes,
)
from samebytes.plans import catalog as plans
from samebytes.sources.store import SnapshotStore

COLUMNS = "id long, library_id long, relative_path string, size_bytes long, mtime_ns long, is_missing boolean, needs_hash boolean, hash_algorithm string, content_hash binary"


def _rows(rng, ids):
    out = []
    for i in ids:
        digest = rng.choice([None, *range(12)])
        out.append((i, 1, f"f{i}", rng.randint(0, 3), 1, rng.random() < 0.1, rng.random() < 0.1, "sha256" if digest is not None else None, None if digest is None else bytes([digest]) * 32))
    return out


def _catalog(spark, rows):
    return conform(spark.createDataFrame(rows, COLUMNS), "library_files")


def _same(left, right):
    return sorted(map(tuple, left.collect())) == sorted(map(tuple, right.select(*left.columns).collect()))


def test_changes_add_up_to_totals_from_scratch(spark):
    rng = random.Random(4)
    rows = {r[0]: r for r in _rows(rng, range(80))}
    catalog = _catalog(spark, list(rows.values()))
    totals = content_totals(catalog)
    for _ in range(4):
        for row in _rows(rng, [rng.randrange(100) for _ in range(25)]):
            rows[row[0]] = row
        for gone in rng.sample(sorted(rows), 6):
            del rows[gone]
        after = _catalog(spark, list(rows.values()))
        totals = spark.createDataFrame(apply_changes(totals, total_changes(catalog, after), after).collect(), content_totals(after).schema)
        catalog = after
        assert _same(totals, content_totals(catalog))
        assert _same(groups_of_totals(totals), duplicate_groups(catalog))


def test_refresh_writes_the_totals_that_changed(spark, tmp_path):
    rng = random.Random(6)
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=32)
    rows = [(i, 1, f"f{i}", 5, 1, False, False, "sha256", bytes([i % 60]) * 32) for i in range(200)]
    store.publish("library_files", _catalog(spark, rows))
    assert _same(plans.refresh_totals(store), content_totals(store.read("library_files")))

    def change(*changed):
        part = _catalog(spark, list(changed))
        touched = store.touched("library_files", part)
        old = store.read("library_files", buckets=touched).join(part.select("id"), "id", "left_anti")
        store.replace("library_files", old.select(*part.columns).unionByName(part), touched)

    # One file changes its content: two contents change.
    before = store.current_version("content_totals")
    change((7, 1, "f7", 1, 1, False, False, "sha256", bytes([9]) * 32))
    assert _same(plans.refresh_totals(store), content_totals(store.read("library_files")))
    assert 1 <= len(store.changed("content_totals", before)) <= 2
    version = store.current_version("content_totals")
    plans.refresh_totals(store)
    assert store.current_version("content_totals") == version

    # A crash leaves totals of a change whose version was not recorded, and then the change is undone.
    recorded = store.read("totals_version").first()
    change((8, 1, "f8", 5, 1, True, False, "sha256", bytes([8]) * 32))
    plans.refresh_totals(store)
    store.publish("totals_version", spark.createDataFrame([tuple(recorded)], "version long, totals long"))
    change((8, 1, "f8", 5, 1, False, False, "sha256", bytes([8]) * 32))
    assert _same(plans.refresh_totals(store), content_totals(store.read("library_files")))

    # Without the older version, or after a whole publish, totals are worked out anew.
    change((9, 1, "f9", 5, 1, True, False, "sha256", bytes([9]) * 32))
    store.retain("library_files", 1)
    assert _same(plans.refresh_totals(store), content_totals(store.read("library_files")))
    store.publish("library_files", _catalog(spark, _rows(rng, range(50))))
    assert _same(plans.refresh_totals(store), content_totals(store.read("library_files")))


def test_changed_files_reach_group_totals_without_state(spark, tmp_path):
    from samebytes.streaming import incremental

    store, drops = SnapshotStore(spark, str(tmp_path / "store"), buckets=4), str(tmp_path / "drops")
    first = [(i, 1, f"f{i}", 5, 1, False, False, "sha256", bytes([i % 3]) * 32) for i in range(9)]
    second = [(0, 1, "f0", 5, 1, True, False, "sha256", bytes([0]) * 32), (1, 1, "f1", 7, 1, False, False, "sha256", bytes([5]) * 32)]
    for rows in (first, second):
        _catalog(spark, rows).coalesce(1).write.mode("append").parquet(drops)
    stream = spark.readStream.schema(_catalog(spark, first).schema).option("maxFilesPerTrigger", 1).parquet(drops)
    query = incremental.group_stream(stream, store, str(tmp_path / "ckpt"))
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    totals = plans.refresh_totals(store)
    assert _same(groups_of_totals(totals), duplicate_groups(store.read("library_files")))
    assert {r.file_count for r in totals.collect()} == {1, 2, 3} and store.read("library_files").count() == 9
