import random

import pytest
from pyspark.sql import functions as F

from samebytes.operators import variants
from samebytes.operators.conform import conform

NOW = "2024-01-16 00:00:00"


def at():
    return F.timestamp_micros(F.lit(1705363200000000))


MATCHED = "thumb_key string, first_seq long, outcome string"


def table(spark, rows):
    """(id, thumb_key, status, seconds until retry or None, group_key, output)"""
    df = spark.createDataFrame(rows, "id long, thumb_key string, status string, wait int, group_key string, output_relpath string")
    df = df.withColumn("retry_after", at() + F.make_dt_interval(secs=F.col("wait")))
    df = df.select(
        "*", F.lit(1).alias("file_id"), F.lit("image").alias("media_type"), F.lit("jpeg").alias("format"),
        F.lit(256).alias("max_dimension"), F.lit(1).alias("source_size_bytes"), F.lit(1).alias("source_mtime_ns"),
        F.lit("E").alias("error_code"), at().alias("created_at"),
    )
    return conform(df, "thumbnails")


def catalog(spark, paths, missing=False):
    rows = [(i + 1, 1, p, 10, 20, missing, False) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "id long, library_id long, relative_path string, size_bytes long, mtime_ns long, is_missing boolean, needs_hash boolean")
    return conform(df, "library_files")


def roots(spark, path="/libraries/media"):
    return spark.createDataFrame([(1, "media", path)], "id long, name string, root_path string")


def requests(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, file_id long, max_dimension int, output_format string")


def admit_by_hand(rows, active, capacity):
    out = {}
    for key, _, outcome in sorted(rows, key=lambda r: (r[1], r[0])):
        if outcome == "new":
            outcome = "admitted" if active < capacity else "queue_full"
        active += outcome in ("admitted", "requeued")
        out[key] = outcome
    return out


@pytest.mark.parametrize("top_k", [True, False])
def test_admission_equals_the_loop(spark, many_slices, monkeypatch, top_k):
    if not top_k:
        monkeypatch.setattr(variants, "TOP_K_ROWS", -1)
    rng = random.Random(7)
    for trial in range(6):
        rows = [(f"k{i}", rng.randint(0, 60), rng.choice(["new", "new", "requeued", "existing", "blocked"])) for i in range(120)]
        active, capacity = rng.randint(0, 30), rng.choice([0, 10, 40, 60, 500])
        current = table(spark, [(i, f"a{i}", rng.choice(["pending", "running"]), None, None, None) for i in range(active)] + [(900, "done", "ready", None, None, None)])
        got = variants.admit(spark.createDataFrame(rows, MATCHED), current, capacity)
        assert {r.thumb_key: r.outcome for r in got.collect()} == admit_by_hand(rows, active, capacity)


def test_equal_requests_are_one_variant(spark):
    planned = variants.plan_requests(requests(spark, [(1, None, None)] * 8), catalog(spark, ["media/photo.jpg"]), roots(spark))
    row = planned.collect()
    assert len(row) == 1 and row[0].requests == 8 and row[0].reject is None
    assert (row[0].max_dimension, row[0].format, row[0].media_type) == (256, "jpeg", "image")
    assert row[0].output_relpath == f"{row[0].thumb_key[:2]}/{row[0].thumb_key[2:4]}/{row[0].thumb_key}.jpg"


@pytest.mark.parametrize(
    "request_row,files,root,reject",
    [
        ((9, 64, "jpeg"), ["a.jpg"], "/libraries/media", "file_not_found"),
        ((1, 64, "png"), ["a.jpg"], "/libraries/media", "unsupported_format"),
        ((1, 999, "jpeg"), ["a.jpg"], "/libraries/media", "bad_dimension"),
        ((1, 64, "jpeg"), ["a.jpg"], "/tmp/escape", "root_outside_libraries"),
        ((1, 64, "jpeg"), ["../a.jpg"], "/libraries/media", "unsafe_path"),
        ((1, 64, "jpeg"), ["a.txt"], "/libraries/media", "unsupported_media"),
        ((1, 64, "jpeg"), ["a.jpg"], None, "root_missing"),
    ],
)
def test_rejects(spark, request_row, files, root, reject):
    known = roots(spark, root) if root else roots(spark).filter("id > 5")
    planned = variants.plan_requests(requests(spark, [request_row]), catalog(spark, files), known)
    row = planned.first()
    assert (row.reject, row.thumb_key, row.output_relpath) == (reject, None, None)


def test_missing_files_are_rejected(spark):
    planned = variants.plan_requests(requests(spark, [(1, 64, "jpeg")]), catalog(spark, ["a.jpg"], missing=True), roots(spark))
    assert planned.first().reject == "file_missing"


@pytest.mark.parametrize("wait,outcome,status", [(300, "blocked", "failed"), (-1, "requeued", "pending"), (None, "requeued", "pending")])
def test_failed_variant_waits_for_its_retry_time(spark, wait, outcome, status):
    planned = variants.plan_requests(requests(spark, [(1, 64, "jpeg")]), catalog(spark, ["a.jpg"]), roots(spark))
    current = table(spark, [(5, planned.first().thumb_key, "failed", wait, None, None)])
    decided = variants.admit(variants.match_variants(planned, current, NOW), current)
    assert decided.first().outcome == outcome
    after = variants.apply_requests(current, decided, NOW).first()
    assert (after.id, after.status) == (5, status)
    assert after.error_code == ("E" if status == "failed" else None)


def test_second_key_finds_the_queue_full(spark):
    planned = variants.plan_requests(requests(spark, [(1, 64, "jpeg"), (2, 64, "jpeg")]), catalog(spark, ["a.jpg", "b.jpg"]), roots(spark))
    empty = table(spark, [])
    decided = variants.admit(variants.match_variants(planned, empty, NOW), empty, 1)
    assert [r.outcome for r in decided.orderBy("first_seq").collect()] == ["admitted", "queue_full"]
    after = variants.apply_requests(empty, decided, NOW).collect()
    assert [(r.id, r.file_id, r.status, r.version) for r in after] == [(1, 1, "pending", 2)]


def test_queue_metrics(spark):
    cleanup = spark.createDataFrame([(1, "g", "pending")], "id long, group_key string, status string")
    cleanup = conform(cleanup.withColumn("execute_after", at() - F.make_dt_interval(secs=F.lit(15))), "thumbnail_cleanup_jobs")
    row = variants.variant_metrics(table(spark, [(1, "k", "failed", 300, None, None)]), cleanup, NOW).first()
    assert row.asDict() == {
        "queue_depth": 0, "queue_pending": 0, "queue_running": 0, "retry_backlog": 1, "retry_ready": 0,
        "cleanup_pending": 1, "cleanup_running": 0, "cleanup_overdue": 1, "cleanup_max_lag_seconds": 15,
    }
    empty = variants.variant_metrics(table(spark, []), cleanup.limit(0), NOW).first()
    assert set(empty.asDict().values()) == {0}


def test_pruning_spares_active_variants(spark):
    current = table(spark, [(1, "a", "ready", None, "g", "x"), (2, "b", "running", None, "g", None), (3, "c", "failed", None, "g", None), (6, "f", "ready", None, "g", "../x"), (4, "d", "ready", None, "h", "y"), (5, "e", "ready", None, None, "z")])
    groups = spark.createDataFrame([(" g ",)], "group_key string")
    listed = variants.prunable_variants(current, groups).collect()
    assert sorted((r.id, r.output_relpath, r.removable) for r in listed) == [(1, "x", True), (3, "", False), (6, "../x", False)]
    assert sorted(r.id for r in variants.prune_variants(current, groups).collect()) == [2, 4, 5]


def test_cleanup_waits_for_active_variants(spark):
    jobs = spark.createDataFrame([(1, "g", "pending"), (2, "h", "pending"), (3, "i", "running")], "id long, group_key string, status string").withColumn("execute_after", at())
    busy = table(spark, [(1, "a", "running", None, "g", None), (2, "b", "ready", None, "h", None)])
    assert [r.id for r in variants.ready_cleanups(jobs, busy, NOW).collect()] == [2]


def test_rescheduling_is_idempotent(spark):
    empty = conform(spark.createDataFrame([], "id long, group_key string, status string, execute_after timestamp"), "thumbnail_cleanup_jobs")
    asked = spark.createDataFrame([(1, "g", 5), (2, " g ", None), (3, " ", 5), (4, "h", -1)], "seq long, group_key string, delay_seconds int")
    once = variants.schedule_cleanups(empty, asked, NOW).collect()
    assert [(r.id, r.group_key, r.status) for r in once] == [(1, "g", "pending")]
    assert once[0].execute_after.timestamp() - once[0].created_at.timestamp() == 600
    twice = variants.schedule_cleanups(spark.createDataFrame(once, empty.schema), asked, NOW).collect()
    assert [tuple(r) for r in twice] == [tuple(r) for r in once]


def test_only_a_few_rows_per_media_type_are_shuffled(spark):
    current = table(spark, []).withColumn("media_type", F.col("thumb_key"))
    plan = variants.next_variants(current, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 2
    assert "Window" not in plan and "Exchange" not in plan


def test_big_tables_stay_in_place_for_small_batches(spark, tmp_path):
    from samebytes.operators.scale import rows_asked_for

    catalog(spark, [f"f{i}.jpg" for i in range(50)]).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files").withColumnRenamed("id", "file_id")
    plan = rows_asked_for(files, spark.range(3).toDF("file_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("small", [True, False])
def test_batches_of_any_size_give_the_same(spark, monkeypatch, small):
    from samebytes.operators import scale

    if not small:
        monkeypatch.setattr(scale, "fits_broadcast", lambda *a, **k: False)
    files = catalog(spark, [f"f{i}.{'jpg' if i % 3 else 'txt'}" for i in range(30)])
    asked = requests(spark, [(i % 40, 256 if i % 5 else 0, "jpeg") for i in range(90)])
    planned = variants.plan_requests(asked, files, roots(spark))
    some = planned.filter("thumb_key IS NOT NULL").orderBy("file_id").limit(6).collect()
    current = table(spark, [(i, r.thumb_key, "ready" if i % 2 else "failed", None if i < 3 else 60, None, None) for i, r in enumerate(some)])
    matched = variants.match_variants(planned, current, NOW)
    assert sorted(r.outcome for r in matched.collect()) == sorted(
        ["existing"] * 3 + ["requeued"] * 2 + ["blocked"] + ["new"] * (planned.filter("reject IS NULL").count() - 6)
    )
    assert {(r.file_id, r.reject) for r in planned.filter("file_id IN (0, 2, 36)").collect()} >= {(2, None), (36, "file_not_found")}
