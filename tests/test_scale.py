import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from samebytes.operators import scale
from samebytes.operators.budget import io_schedule, io_state
from samebytes.operators.stats import nearest_rank

MIB = 1024 * 1024


def test_positions_over_slices_with_a_hot_value(spark, many_slices):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, rng.randint(0, 50)]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "v long, i long").repartition(5)
    placed = scale.with_position(df, [F.desc("v"), F.asc("i")], "at").orderBy("at").collect()
    assert [(r.v, r.i) for r in placed] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["at"] for r in placed] == list(range(3000))


def test_slices_split_a_hot_key(spark, many_slices):
    df = spark.range(8000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5)).alias("k"), "id")
    sizes = scale.ordered_slices(df, ["k", "id"]).groupBy("_slice").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 8000 / 3


@pytest.mark.parametrize("seed", [1, 2])
def test_previous_row_over_slices(spark, many_slices, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", f"k{rng.randint(0, 30)}", None]), rng.randint(0, 400), i, rng.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, s string")
    found = scale.with_previous(df, "k", ["t", "i"], {"s": "before"}).collect()
    expected = {}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    for _, group in groupby(ordered, key=lambda r: r[0]):
        before = None
        for row in group:
            expected[row[2]], before = before, row[3]
    assert {r.i: r.before for r in found} == expected


def test_wide_rows_do_not_fit_a_broadcast(spark, monkeypatch):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.lit(None).cast("binary").alias("b"))
    assert scale.fits_broadcast(df) and not scale.fits_broadcast(df, 99)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 100_000)
    assert not scale.fits_broadcast(df) and scale.fits_broadcast(df.select("id", "b"))
    assert scale.fits_broadcast(df.limit(0))


def test_lookup_join_without_broadcast_gives_the_same(spark):
    big = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"))
    hinted = scale.lookup_join(big, small, "k")
    plain = scale.lookup_join(big, small, "k", max_rows=2)
    assert "ResolvedHint" in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plain._jdf.queryExecution().analyzed().toString()
    assert hinted.count() == plain.count() == 500


@pytest.mark.parametrize("limit", [0, 5, 500])
def test_first_rows_both_ways(spark, many_slices, monkeypatch, limit):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("v"))
    top = sorted(r.v for r in scale.first_rows(df, ["v"], limit).collect())
    monkeypatch.setattr(scale, "TOP_K_ROWS", -1)
    assert sorted(r.v for r in scale.first_rows(df, ["v"], limit).collect()) == top == list(range(min(limit, 200)))


def test_rows_not_in_both_ways(spark):
    rows, table = spark.range(50), spark.range(0, 100, 3)
    expected = [i for i in range(50) if i % 3]
    for max_rows in (0, 1000):
        assert sorted(r.id for r in scale.rows_not_in(rows, table, ["id"], max_rows).collect()) == expected


def schedule_by_hand(rows, rate, state):
    free, out = dict(state), {}
    for bucket, now, size, seq in sorted(rows, key=lambda r: (r[1], r[3])):
        if size <= 0:
            out[seq] = (now, 0, now)
            continue
        budget = max(-(-size * 1000 // (rate * MIB)), 1)
        end = max(free.get(bucket, 0), now) + budget
        free[bucket] = end
        out[seq] = (end - budget, max(end - budget - now, 0), end)
    return out, free


@pytest.mark.parametrize("buckets", [("one",), ("hot", "hot", "hot", "a", "b")])
@pytest.mark.parametrize("state", [{}, {"one": 40_000, "a": 90_000, "hot": 5}])
def test_io_schedule_equals_the_loop(spark, many_slices, buckets, state):
    rng = random.Random(len(buckets) + len(state))
    now, rows = 1000, []
    for seq in range(1500):
        now += rng.choice([0, 0, 3, 400, 1500])
        rows.append((rng.choice(buckets), now, rng.choice([0, 1, 3 * MIB, rng.randint(1, 2 * MIB)]), seq))
    expected, free = schedule_by_hand(rows, 3, state)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "bucket_key string, now_ms long, bytes long, seq long")
    prior = spark.createDataFrame(list(state.items()), "bucket_key string, next_available_at_ms long") if state else None
    schedule = io_schedule(df, 3, order=["now_ms", "seq"], state=prior)
    got = {r.seq: (r.start_ms, r.delay_ms, r.end_ms) for r in schedule.collect()}
    assert got == expected
    after = {r.bucket_key: r.next_available_at_ms for r in io_state(schedule).collect()}
    assert after == {k: v for k, v in free.items() if k in after} and set(after) == set(buckets)


def test_no_limit_means_no_delay(spark):
    df = spark.createDataFrame([("a", 5, 10**15, 1)], "bucket_key string, now_ms long, bytes long, seq long")
    row = io_schedule(df, 0, order=["now_ms", "seq"]).first()
    assert (row.budget_ms, row.start_ms, row.delay_ms) == (0, 5, 0)


@pytest.mark.parametrize("values", [[], [4.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], [float(i) for i in range(101)]])
def test_nearest_rank(spark, many_slices, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).first()
    ordered = sorted(values) or [0.0]
    assert tuple(row) == tuple(ordered[round((len(ordered) - 1) * r)] for r in (0.5, 0.95, 1.0))


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Nothing:
                            @staticmethod
                            def isDefined():
                                return False

                        return Nothing

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        scale.shared_folder(Session)


def test_rows_are_shuffled_once(spark, many_slices):
    """Behind the frozen slices only one summary row per slice moves; a hot bucket makes no difference."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("bucket_key"),
        F.col("id").alias("now_ms"), F.lit(5 * MIB).alias("bytes"), F.col("id").alias("seq"),
    )
    plan = io_schedule(rows, 3, order=["now_ms", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")
    plan = scale.with_previous(rows, "bucket_key", ["seq"], {"bytes": "before"})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_slice" in plan and plan.count("partial_max_by") == 1 and "rangepartitioning" not in plan


def test_running_passes_over_small_batches(spark, many_slices, settings):
    """State is carried from batch to batch and from slice to slice."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, "a", "b"]), i, rng.randint(1, 5 * MIB), i) for i in range(900)]
    expected, _ = schedule_by_hand(rows, 3, {})
    df = spark.createDataFrame(rows, "bucket_key string, now_ms long, bytes long, seq long")
    with settings(spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        schedule = io_schedule(df, 3, order=["now_ms", "seq"])
        assert {r.seq: (r.start_ms, r.delay_ms, r.end_ms) for r in schedule.collect()} == expected
        lagged = scale.with_previous(df, "bucket_key", ["seq"], {"bytes": "before", "seq": "at"}).collect()
    last = {}
    for row in sorted(lagged, key=lambda r: r.seq):
        assert (row.before, row["at"]) == last.get(row.bucket_key, (None, None))
        last[row.bucket_key] = (row.bytes, row.seq)
