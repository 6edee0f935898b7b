import random
import re

import pytest
from pyspark.sql import functions as F

from samebytes.operators import merge
from samebytes.operators.conform import conform
from samebytes.schemas import LIBRARY_FILES

NOW = "2024-01-16 00:00:00"
STATE = ("hash_algorithm", "content_hash", "hash_error_count", "hash_claim_token")


def random_catalog(rng, size):
    rows = []
    for number in range(1, size + 1):
        rows.append(
            {
                "id": number,
                "library_id": rng.randint(1, 3),
                "relative_path": f"p{number}",
                "size_bytes": rng.randint(0, 2),
                "mtime_ns": rng.randint(0, 2),
                "inode": rng.choice([None, -1, 5]),
                "device": rng.choice([None, 1]),
                "is_missing": rng.random() < 0.3,
                "needs_hash": rng.random() < 0.3,
                "last_seen_scan_id": rng.choice([None, 1]),
                "hash_algorithm": "sha256",
                "content_hash": bytes([number % 256]) * 32,
                "hash_error_count": rng.randint(0, 3),
                "hash_claim_token": rng.choice([None, "t"]),
            }
        )
    return rows


def random_scan(rng, catalog):
    scan = []
    for row in catalog:
        if rng.random() < 0.7 and row["library_id"] != 3:
            seen = {k: row[k] for k in ("library_id", "relative_path", "size_bytes", "mtime_ns", "inode", "device")}
            if rng.random() < 0.3:
                seen[rng.choice(["size_bytes", "mtime_ns"])] += 1
            if rng.random() < 0.3:
                seen["inode"] = rng.choice([None, -1, 6])
            scan.append(seen)
    for number in range(10):
        scan.append({"library_id": 1 + number % 2, "relative_path": f"new{number:02d}", "size_bytes": 1, "mtime_ns": 1, "inode": None, "device": 2})
    rng.shuffle(scan)
    return scan


def upsert_by_hand(catalog, scan, scanned, scan_id, complete):
    """What happens if every scanned file is stored one after the other."""
    table = {(r["library_id"], r["relative_path"]): dict(r) for r in catalog}
    new_id = max(r["id"] for r in catalog)
    void = lambda value: -1 if value is None else value
    for seen in sorted(scan, key=lambda r: (r["library_id"], r["relative_path"])):
        key = (seen["library_id"], seen["relative_path"])
        old = table.get(key)
        if old is None:
            new_id += 1
            old = {"id": new_id, "needs_hash": True, "hash_algorithm": None, "content_hash": None, "hash_error_count": 0, "hash_claim_token": None}
        elif (
            old["is_missing"]
            or (old["size_bytes"], old["mtime_ns"]) != (seen["size_bytes"], seen["mtime_ns"])
            or (void(old["inode"]), void(old["device"])) != (void(seen["inode"]), void(seen["device"]))
        ):
            old.update(needs_hash=True, hash_algorithm=None, content_hash=None, hash_error_count=0, hash_claim_token=None)
        table[key] = {**old, **seen, "is_missing": False, "last_seen_scan_id": scan_id}
    if complete:
        for row in table.values():
            if row["library_id"] in scanned and row["last_seen_scan_id"] != scan_id and not row["is_missing"]:
                row.update(is_missing=True, needs_hash=False, hash_claim_token=None)
    return table


COMPARED = ("id", "library_id", "relative_path", "size_bytes", "mtime_ns", "inode", "device", "is_missing", "needs_hash", "last_seen_scan_id", *STATE)


def frames(spark, catalog, scan, scanned):
    kinds = {f.name: f.dataType.simpleString() for f in LIBRARY_FILES}

    def frame(rows, names):
        schema = ", ".join(f"{n} {kinds[n]}" for n in names)
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    files = conform(frame(catalog, list(catalog[0])), "library_files")
    seen = frame(scan, ["library_id", "relative_path", "size_bytes", "mtime_ns", "inode", "device"])
    return files, seen, spark.createDataFrame([(i,) for i in scanned], "library_id long")


def as_tuples(rows):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows)


@pytest.mark.parametrize("small_rows", [0, 1000])
@pytest.mark.parametrize("seed,complete", [(1, True), (2, False)])
def test_merge_equals_row_by_row_upsert(spark, many_slices, seed, complete, small_rows):
    rng = random.Random(seed)
    catalog = random_catalog(rng, 90)
    scan, scanned = random_scan(rng, catalog), [1, 2]
    files, seen, libraries = frames(spark, catalog, scan, scanned)
    ids = merge.assign_ids(files, seen)
    merged = merge.merge_scan(files, seen, libraries, scan_id=9, now=NOW, complete=complete, new_ids=ids, small_rows=small_rows)
    by_hand = upsert_by_hand(catalog, scan, scanned, 9, complete).values()
    assert as_tuples(merged.select(*COMPARED).collect()) == as_tuples(
        tuple(r.get(c) for c in COMPARED) for r in by_hand
    )
    assert merged.schema.fieldNames() == [*LIBRARY_FILES.fieldNames(), "change"]


def test_merging_the_same_scan_again_changes_nothing(spark):
    rng = random.Random(4)
    catalog = random_catalog(rng, 40)
    files, seen, libraries = frames(spark, catalog, random_scan(rng, catalog), [1, 2, 3])

    def merged(into):
        ids = merge.assign_ids(into, seen)
        return merge.merge_scan(into, seen, libraries, scan_id=9, now=NOW, new_ids=ids)

    once = merged(files).drop("change").cache()
    twice = merged(once)
    assert as_tuples(once.select(*COMPARED).collect()) == as_tuples(twice.select(*COMPARED).collect())
    assert {r.change for r in twice.select("change").distinct().collect()} <= {"unchanged", "untouched"}
    once.unpersist()


def test_reappearing_file_loses_its_hash_and_a_missing_one_keeps_it(spark):
    base = {"mtime_ns": 1, "inode": 1, "device": 1, "needs_hash": False, "last_seen_scan_id": 1, "hash_algorithm": "sha256", "content_hash": b"x" * 32, "hash_error_count": 0, "hash_claim_token": "t", "size_bytes": 1, "library_id": 1}
    catalog = [
        {**base, "id": 1, "relative_path": "back", "is_missing": True},
        {**base, "id": 2, "relative_path": "gone", "is_missing": False},
    ]
    scan = [{k: catalog[0][k] for k in ("library_id", "relative_path", "size_bytes", "mtime_ns", "inode", "device")}]
    files, seen, libraries = frames(spark, catalog, scan, [1])
    rows = {r.relative_path: r for r in merge.merge_scan(files, seen, libraries, scan_id=2, now=NOW).collect()}
    assert (rows["back"].change, rows["back"].content_hash, rows["back"].needs_hash) == ("reappeared", None, True)
    assert (rows["gone"].change, bytes(rows["gone"].content_hash)) == ("missing", b"x" * 32)
    assert (rows["gone"].needs_hash, rows["gone"].hash_claim_token) == (False, None)


def test_merge_shuffles_each_side_once(spark, settings):
    rng = random.Random(5)
    catalog = random_catalog(rng, 30)
    files, seen, libraries = frames(spark, catalog, random_scan(rng, catalog), [1])
    ids = merge.assign_ids(files, seen)
    with settings(spark__sql__autoBroadcastJoinThreshold="-1"):
        merged = merge.merge_scan(files, seen, libraries, scan_id=9, now=NOW, new_ids=ids, small_rows=0)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    # catalog, scan and new ids
    assert len(re.findall(r"Exchange hashpartitioning\((?:o_)?library_id", plan)) == 3
    assert plan.count("FullOuter") == 1 and "Cartesian" not in plan


def test_small_scan_does_not_shuffle_the_catalog(spark, tmp_path):
    rng = random.Random(8)
    catalog = random_catalog(rng, 30)
    files, seen, libraries = frames(spark, catalog, random_scan(rng, catalog), [1])
    files.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    merged = merge.merge_scan(files, seen, libraries, scan_id=9, now=NOW, new_ids=merge.assign_ids(files, seen))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    catalog_side = plan.split("BroadcastHashJoin [o_library_id")[2].split("FileScan")[0]
    assert "Exchange" not in catalog_side.split("BroadcastExchange")[0] and "FullOuter" not in plan


def test_roots_are_upserted_by_name(spark):
    roots = conform(spark.createDataFrame([(3, "b", "/old/b")], "id long, name string, root_path string"), "library_roots")
    found = spark.createDataFrame([("a", "/l/a"), ("b", "/l/b"), ("c", "/l/c")], "name string, root_path string")
    after = merge.register_roots(roots, found, NOW).select("id", "name", "root_path").collect()
    assert sorted(map(tuple, after)) == [(3, "b", "/l/b"), (4, "a", "/l/a"), (5, "c", "/l/c")]


def test_bucketed_catalog_is_not_shuffled(spark, settings):
    from samebytes.operators.duplicates import duplicate_groups
    from samebytes.sources.store import save_bucketed

    rng = random.Random(6)
    catalog = random_catalog(rng, 50)
    files, seen, libraries = frames(spark, catalog, random_scan(rng, catalog), [1])
    table = save_bucketed(files, "bucketed_by_path", ["library_id", "relative_path"], 8)
    with settings(spark__sql__autoBroadcastJoinThreshold="-1"):
        merged = merge.merge_scan(table, seen, libraries, scan_id=9, now=NOW)
        plan = merged._jdf.queryExecution().executedPlan().toString()
    join = plan.split("FullOuter")[1]
    assert "Exchange" not in join.split("FileScan")[0]
    groups = duplicate_groups(save_bucketed(files, "bucketed_by_hash", ["hash_algorithm", "content_hash"], 8))
    assert "Exchange" not in groups._jdf.queryExecution().executedPlan().toString()
    assert groups.count() == duplicate_groups(files.select(*[F.col(c) for c in files.columns])).count()
