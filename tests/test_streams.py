from datetime import datetime, timedelta
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from checks.compare import rows_of
from checks.registry import ORACLES, QUERIES
from checks.streams import _Streams
from checks.views import Tables
from samebytes.operators.duplicates import duplicate_groups
from samebytes.operators.scale import shared_folder
from samebytes.sources.store import SnapshotStore
from samebytes.streaming import incremental

NOW = "2026-01-01 00:00:00"
SCAN = "library_id long, relative_path string, size_bytes long, mtime_ns long, inode long, device long"
FILE = "id long, size_bytes long, is_missing boolean, needs_hash boolean, hash_algorithm string, content_hash binary"


def drop(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_drops_are_merged_and_replays_change_nothing(spark, tmp_path):
    drops, store = str(tmp_path / "drops"), SnapshotStore(spark, str(tmp_path / "store"))
    drop(spark, drops, [(1, "a", 1, 1, None, None), (1, "b", 1, 1, None, None), (1, "a", 2, 5, None, None)], SCAN)

    def run(checkpoint):
        stream = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(drops)
        incremental.merge_stream(stream, store, str(tmp_path / checkpoint), scan_id=1, now=NOW).awaitTermination()
        return {r.relative_path: (r.id, r.size_bytes) for r in store.read("library_files").collect()}

    assert run("one") == {"a": (1, 2), "b": (2, 1)}
    drop(spark, drops, [(1, "b", 9, 2, None, None), (2, "c", 1, 1, None, None)], SCAN)
    assert run("one") == {"a": (1, 2), "b": (2, 9), "c": (3, 1)}
    versions = store.current_version("library_files")
    # Without its commit the last batch is run again, and skipped.
    (tmp_path / "one" / "commits" / "1").unlink()
    (tmp_path / "one" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run("one") == {"a": (1, 2), "b": (2, 9), "c": (3, 1)}
    assert store.current_version("library_files") == versions
    # A new checkpoint numbers its batches anew; nothing it brings may be skipped.
    drop(spark, drops, [(2, "d", 4, 4, None, None)], SCAN)
    assert run("two") == {"a": (1, 2), "b": (2, 9), "c": (3, 1), "d": (4, 4)}
    assert store.current_version("library_files") == versions + 3


def collect(spark, query, folder, mode="append"):
    rows = str(folder / "rows")

    def write(batch, batch_id):
        batch.write.mode("append").parquet(rows)

    writer = query.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "checkpoint"))
    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(rows)


def test_requests_are_deduplicated_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    start = datetime(2026, 1, 1)
    for hour in range(3):
        drop(spark, source, [(f"k{i}", start + timedelta(minutes=10 * hour + i)) for i in range(3)], "thumb_key string, ts timestamp")
    stream = spark.readStream.schema("thumb_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    for name, time in (("forever", None), ("watermark", "ts")):
        folder = tmp_path / name
        folder.mkdir()
        rows = collect(spark, incremental.distinct_requests(stream, time=time), folder)
        assert sorted(r.thumb_key for r in rows.collect()) == ["k0", "k1", "k2"]


def test_silent_workers(spark, tmp_path):
    start = datetime(2026, 1, 1)
    beats = [("a", 0), ("a", 100), ("a", 399), ("a", 800), ("b", 0), ("b", 5000)]
    source = str(tmp_path / "in")
    drop(spark, source, [(w, start + timedelta(seconds=s)) for w, s in beats], "worker string, ts timestamp")

    def spans(df):
        return sorted((r.worker, (r.first_heartbeat - start).seconds, (r.stale_at - start).seconds, r.heartbeats) for r in df.collect())

    expected = [("a", 0, 699, 3), ("a", 800, 1100, 1), ("b", 0, 300, 1), ("b", 5000, 5300, 1)]
    assert spans(incremental.silent_workers(spark.read.parquet(source))) == expected
    stream = spark.readStream.schema("worker string, ts timestamp").parquet(source)
    # The last span is still open: nothing newer has been seen.
    assert spans(collect(spark, incremental.silent_workers(stream), tmp_path)) == expected[:-1]


def test_group_totals_grow_to_the_batch_result(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        rows = [(10 * part + i, 5 + i, False, False, "sha256", bytes([i % 4]) * 32) for i in range(6)]
        drop(spark, source, rows, FILE)
    stream = spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(source)
    latest = incremental.latest_groups(collect(spark, incremental.running_groups(stream), tmp_path, "update"))
    batch = duplicate_groups(spark.read.parquet(source)).select(latest.columns)
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, batch.collect()))
    assert latest.agg(F.sum("file_count")).first()[0] == 18


def test_a_clock_ends_the_last_spans(spark, tmp_path):
    start = datetime(2026, 1, 1)
    beats, ticks = str(tmp_path / "beats"), str(tmp_path / "ticks")
    drop(spark, beats, [(w, start + timedelta(seconds=s)) for w, s in [("a", 0), ("a", 100), ("b", 4000)]], "worker string, ts timestamp")
    drop(spark, ticks, [(start + timedelta(hours=3),)], "ts timestamp")
    rows = [spark.readStream.schema(schema).parquet(path) for path, schema in ((beats, "worker string, ts timestamp"), (ticks, "ts timestamp"))]
    found = collect(spark, incremental.silent_workers(rows[0], clock=rows[1]), tmp_path)
    assert sorted((r.worker, r.heartbeats) for r in found.collect()) == [("a", 2), ("b", 1)]
    # Over tables a clock changes nothing.
    tables = spark.read.parquet(beats), spark.read.parquet(ticks)
    assert sorted((r.worker, r.heartbeats) for r in incremental.silent_workers(tables[0], clock=tables[1]).collect()) == [("a", 2), ("b", 1)]


def test_request_keys_leave_the_state(spark, tmp_path):
    """A repeat within the delay is dropped; one behind the watermark is late and dropped too; a new time counts anew."""
    source, start = str(tmp_path / "in"), datetime(2026, 1, 1)
    schema = "thumb_key string, ts timestamp"
    drop(spark, source, [("k", start), ("old", start)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    unique = incremental.distinct_requests(stream, time="ts", delay="1 hour")
    states, out = [], str(tmp_path / "rows")

    def run():
        query = unique.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    run()
    drop(spark, source, [("k", start + timedelta(minutes=30))], schema)
    run()
    drop(spark, source, [("new", start + timedelta(hours=5))], schema)
    run()
    drop(spark, source, [("old", start), ("k", start + timedelta(hours=6))], schema)
    run()
    rows = sorted((r.thumb_key, r.ts.hour) for r in spark.read.parquet(out).collect())
    assert rows == [("k", 0), ("k", 6), ("new", 5), ("old", 0)]
    assert max(states) <= 3 and states[-1] <= 2


def test_new_files_on_disk_reach_the_catalog(spark, tmp_path):
    """Two runs bring what a batch merge of the same files would bring, with the same ids."""
    from samebytes.operators import merge
    from samebytes.operators.conform import conform
    from samebytes.sources import filetree

    root, store = tmp_path / "libs", SnapshotStore(spark, str(tmp_path / "store"), buckets=4)
    for name in ("one", "two", "unknown"):
        (root / name / "sub").mkdir(parents=True)
        (root / name / "sub" / "a.txt").write_text(name)
        (root / name / "b.txt").write_text("b")
    roots = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    store.publish("library_roots", conform(roots.withColumn("root_path", F.lit(str(root))), "library_roots"))

    def run():
        query = incremental.watch_libraries(store, str(root), str(tmp_path / "ckpt"), scan_id=5, now=NOW, lag_seconds=0)
        query.awaitTermination()
        return {(r.library_id, r.relative_path): (r.id, r.size_bytes) for r in store.read("library_files").collect()}

    def batch(catalog):
        ids = roots.select(F.col("name").alias("library"), F.col("id").alias("library_id"))
        scan = filetree.read_tree(spark, str(root)).filter("kind = 'file'").join(ids, "library")
        after = merge.merge_scan(catalog, scan, scan.select("library_id").limit(0), scan_id=5, now=NOW, complete=False, new_ids=merge.assign_ids(catalog, scan))
        return {(r.library_id, r.relative_path): (r.id, r.size_bytes) for r in after.collect()}

    expected = batch(store.read("library_files"))
    assert run() == expected and len(expected) == 4
    before = store.read("library_files")
    (root / "two" / "b.txt").write_text("longer")
    (root / "one" / "c.txt").write_text("new")
    (root / "one" / "sub" / "a.txt").rename(root / "one" / "moved.txt")
    expected = batch(before)
    assert run() == expected and len(expected) == 6
    version = store.current_version("library_files")
    assert run() == expected
    assert store.current_version("library_files") <= version + 1


def _documents(spark, folder, files=6, rows=90):
    """Documents with copies, in a folder of several files."""
    made = [(i, f"text {i % 25}" if i % 14 else None, ("en", "de")[i % 2], f"src{i % 7}") for i in range(rows)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    table.repartition(files).write.parquet(f"{folder}/documents.parquet")


def _agrees_with_sql(spark, folder, name, *tables):
    connection = duckdb.connect()
    for table in tables:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/**/*.parquet'")
    rows, result = QUERIES[name](Tables(spark, folder)), connection.execute(ORACLES[name])
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    return rows_of(rows.columns, [tuple(r) for r in rows.collect()]) == expected and len(expected[1]) > 0


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    folder, start = str(tmp_path), datetime(2026, 1, 1)
    _documents(spark, folder)
    events = [(i, i % 4, start + timedelta(minutes=i), float(i)) for i in range(40)]
    table = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, value double")
    table.repartition(3).write.parquet(f"{folder}/events.parquet")
    assert _agrees_with_sql(spark, folder, "x4_running_groups", "documents")
    assert _agrees_with_sql(spark, folder, "x2_request_deduplication", "events")
    assert _agrees_with_sql(spark, folder, "x3_lease_silence", "events")


def test_streams_read_tables_that_are_partitioned_or_single_files(spark, tmp_path):
    _documents(spark, str(tmp_path / "flat"))
    rows = spark.read.parquet(str(tmp_path / "flat" / "documents.parquet"))
    rows.write.partitionBy("lang").parquet(str(tmp_path / "parts" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    found = [
        sorted(map(tuple, QUERIES["x4_running_groups"](Tables(spark, str(tmp_path / kind))).collect()))
        for kind in ("flat", "parts", "one")
    ]
    assert found[0] == found[1] == found[2] and found[0]
    langs = [r.lang for r in collect(spark, _Streams(spark, str(tmp_path / "parts")).documents, tmp_path).collect()]
    assert sorted(langs) == sorted(r.lang for r in rows.collect())


def _batches(spark, kind):
    """Files that each batch of a query's stream has read, by the log of its checkpoint, by folder."""
    found = {}
    for folder in Path(shared_folder(spark).removeprefix("file:")).glob("ckpt-*"):
        logs = sorted((folder / "sources" / "0").glob("[0-9]*"), key=lambda p: int(p.name))
        found[folder.name] = [p.read_text().count(f"/{kind}-") for p in logs]
    return found


def test_drops_of_a_scan_are_written_by_many_tasks(spark, tmp_path):
    folder = str(tmp_path)
    _documents(spark, folder)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(30)], "page_id long, html string")
    for name, table in (("labels", labels), ("pages", pages)):
        table.repartition(2).write.parquet(f"{folder}/{name}.parquet")
    before = _batches(spark, "drops")
    assert _agrees_with_sql(spark, folder, "x1_incremental_catalog", "documents", "labels", "pages")
    (files,) = [v for k, v in _batches(spark, "drops").items() if k not in before]
    assert len(files) == 3 and min(files) > 1


def test_drops_of_a_catalog_are_written_by_many_tasks(spark, tmp_path):
    _documents(spark, str(tmp_path))
    before = _batches(spark, "drops")
    assert _agrees_with_sql(spark, str(tmp_path), "x4_group_table", "documents")
    (files,) = [v for k, v in _batches(spark, "drops").items() if k not in before]
    assert len(files) == 2 and min(files) > 1
