"""Chunked windows, gap repair, quantiles and as-of joins against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltmill.operators import features, joins, quantiles, series, silver

START = dt.datetime(2024, 1, 1)


def hourly(spark, values, asset="a", step_hours=1):
    rows = [
        (asset, START + dt.timedelta(hours=i * step_hours), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp, v double")


def filled(spark, values, **options):
    df = silver.fill_short_gaps(hourly(spark, values), ["v"], **options)
    return [r.v for r in df.orderBy("timestamp_utc").collect()]


@pytest.mark.parametrize("bucket", [3600, 2 * 3600, 30 * 86400])
@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([1, None, None, 5], [1, 2.3333, 3.6667, 5]),
        ([1, None, None, None, None, None, 11], [1, 2.6667, 4.3333, 6, 6, None, 11]),
        ([1, None, None, None, None, None, None], [1, 1, 1, 1, 1, None, None]),
        ([None, None, 3], [None, None, 3]),
    ],
)
def test_gap_repair(spark, values, expected, bucket):
    got = filled(spark, values, bucket_seconds=bucket)
    assert [None if v is None else round(v, 4) for v in got] == expected


def test_gap_repair_time_aware(spark):
    rows = [("a", START, 0.0), ("a", START + dt.timedelta(hours=1), None), ("a", START + dt.timedelta(hours=4), 8.0)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp, v double")
    by_row = silver.fill_short_gaps(df, ["v"]).orderBy("timestamp_utc").collect()[1].v
    by_time = silver.fill_short_gaps(df, ["v"], time_aware=True).orderBy("timestamp_utc").collect()[1].v
    assert (by_row, by_time) == (4.0, 2.0)


def test_gap_repair_equals_pandas_on_random_series(spark):
    rng = random.Random(7)
    frames, expected = [], {}
    for asset in "abc":
        values = [rng.uniform(0, 9) if rng.random() < 0.35 else None for _ in range(120)]
        frames.append(hourly(spark, values, asset))
        known = pd.Series(values, dtype=float)
        expected[asset] = known.interpolate(limit=3).ffill(limit=1)
    df = frames[0].unionByName(frames[1]).unionByName(frames[2])
    got = silver.fill_short_gaps(df, ["v"], bucket_seconds=7 * 3600).toPandas()
    for asset, wanted in expected.items():
        mine = got[got.asset_id == asset].sort_values("timestamp_utc")["v"].to_numpy()
        np.testing.assert_allclose(mine, wanted.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_rolling_mean_shape(spark, chunk):
    df = hourly(spark, [1, 2, None, 4, 5, 6, 7, 8])
    out = features.lags_and_rolling(
        df, "v", {"lag_1": 1}, window=4, min_periods=2, rolling="mean", chunk_rows=chunk, bucket_seconds=3 * 3600
    )
    got = [None if r.mean is None else round(r.mean, 4) for r in out.orderBy("timestamp_utc").collect()]
    assert got == [None, None, 1.5, 1.5, 2.3333, 3.6667, 5.0, 5.5]


def test_lag_and_mean_do_not_see_the_current_row(spark):
    values = [float(i % 17) for i in range(72)]
    changed = list(values)
    changed[30] = 999.0
    rows = []
    for version in (values, changed):
        out = features.lags_and_rolling(hourly(spark, version), "v").orderBy("timestamp_utc").collect()
        rows.append(out[30])
        assert out[24].lag_24h_mw == version[0]
    assert rows[0].rolling_24h_mw == rows[1].rolling_24h_mw


def test_row_and_time_modes_agree_without_gaps(spark):
    df = hourly(spark, [float((i * 37) % 101) for i in range(400)])
    by_row = features.lags_and_rolling(df, "v", chunk_rows=200).toPandas().sort_values("timestamp_utc")
    by_time = features.lags_and_rolling(df, "v", mode="time", bucket_seconds=8 * 86400)
    by_time = by_time.toPandas().sort_values("timestamp_utc")
    for column in ("lag_1h_mw", "lag_24h_mw", "lag_168h_mw", "rolling_24h_mw"):
        np.testing.assert_allclose(by_row[column].to_numpy(float), by_time[column].to_numpy(float))


def test_five_minute_rows_differ_from_hours(spark):
    rows = [("a", START + dt.timedelta(minutes=5 * i), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp, v double")
    by_row = features.lags_and_rolling(df, "v").orderBy("timestamp_utc").collect()[399]
    by_time = features.lags_and_rolling(df, "v", mode="time").orderBy("timestamp_utc").collect()[399]
    assert by_row.lag_24h_mw == 375.0
    assert by_time.lag_24h_mw == 399.0 - 288.0


def test_energy_over_five_minutes(spark):
    rows = [("a", START + dt.timedelta(minutes=5 * i), 12.0) for i in range(13)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp, power_mw double")
    total = features.integrate_energy(df, chunk_rows=5).agg(F.sum("energy_integral_mwh")).first()[0]
    assert total == pytest.approx(12.0)


def test_positions_are_dense_for_a_hot_series(spark):
    rows = [("hot", START + dt.timedelta(minutes=i)) for i in range(5000)] + [("cold", START)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp").repartition(5)
    numbered = series.number_rows(df, ["asset_id"], "timestamp_utc", bucket_seconds=3600)
    assert numbered.select("_bucket").distinct().count() > 50
    got = [r._pos for r in numbered.filter("asset_id = 'hot'").orderBy("timestamp_utc").collect()]
    assert got == list(range(5000))


@pytest.mark.parametrize("accuracy", [10, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_equal_numpy(spark, accuracy, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "spread": rng.normal(size=3000),
        "ties": np.repeat([1.0, 2.0, 3.0], [2000, 10, 5]),
        "single": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.3, 0.5, 0.7, 0.982, 1.0]
    got = quantiles.exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()
    assert len(got) == len(groups) * len(probs)
    for row in got:
        assert row.quantile == pytest.approx(np.quantile(groups[row.g], row.prob), abs=1e-9)


def test_array_quantiles(spark):
    rows = [("a", float(v)) for v in (1, 2, 4, 9, 10, 50)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = quantiles.group_percentiles(df, ["k"], "v", [0.3, 0.7, 0.1]).first().quantiles
    assert [round(v, 6) for v in out] == [3.0, 9.5, 1.5]


@pytest.mark.parametrize("bucket", [600, 86_400])
def test_nearest_asof_equals_brute_force(spark, bucket):
    rng = random.Random(11)
    left = [("a" if rng.random() < 0.8 else "b", START + dt.timedelta(seconds=rng.randrange(20_000)), i) for i in range(200)]
    right = [("a", START + dt.timedelta(seconds=s), s) for s in sorted({rng.randrange(20_000) for _ in range(60)})]
    out = joins.nearest_asof(
        spark.createDataFrame(left, "k string, ts timestamp, i int"),
        spark.createDataFrame(right, "k string, rts timestamp, s int"),
        ["k"], "ts", "rts", ["s"], bucket_seconds=bucket,
    ).collect()
    assert len(out) == len(left)
    for row in out:
        options = [(abs((ts - row.ts).total_seconds()), ts, s) for k, ts, s in right if k == row.k]
        assert row.matched_s == (min(options)[2] if options else None)


def test_nearest_asof_tolerance(spark):
    left = spark.createDataFrame([("a", START)], "k string, ts timestamp")
    right = spark.createDataFrame([("a", START + dt.timedelta(hours=2), 5)], "k string, rts timestamp, s int")
    hit = lambda t: joins.nearest_asof(left, right, ["k"], "ts", "rts", ["s"], t).first().matched_s
    assert (hit(7200), hit(7199)) == (5, None)


def test_dedup_keeps_one_row_and_prunes_before_the_shuffle(spark):
    rows = [("a", START, START + dt.timedelta(minutes=i), i) for i in range(500)] + [("b", START, START, 1)]
    df = spark.createDataFrame(
        rows, "asset_id string, timestamp_utc timestamp, ingested_at timestamp, event_sequence long"
    )
    out = silver.dedup_latest(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert sorted((r.asset_id, r.event_sequence) for r in out.collect()) == [("a", 499), ("b", 1)]


def test_label_intervals_half_open(spark):
    readings = hourly(spark, range(10))
    windows = spark.createDataFrame(
        [("a", START + dt.timedelta(hours=2), START + dt.timedelta(hours=4), "w")],
        "asset_id string, window_start timestamp, window_end timestamp, scenario string",
    )
    got = joins.label_intervals(readings, windows, bucket_seconds=3600).orderBy("timestamp_utc").collect()
    assert [r.v for r in got] == [2.0, 3.0]


def hot_table(spark, rows=6000):
    """One series with nine tenths of the rows, most of them in a few minutes, and times that occur twice."""
    rng = random.Random(12)
    data = []
    for i in range(rows):
        asset = "hot" if i % 10 else rng.choice("bcd")
        at = rng.randrange(600) if rng.random() < 0.6 else rng.randrange(400 * 86400)
        data.append((asset, START + dt.timedelta(seconds=at), float(i) if rng.random() < 0.7 else None, i))
    return spark.createDataFrame(data, "asset_id string, timestamp_utc timestamp, v double, n long")


def test_splitters_bound_every_bucket(spark):
    """No task gets more than a bucket's rows and one second of them, wherever the rows of the hot series lie."""
    df = hot_table(spark)
    for limit in (100, 500, 5000):
        placed = series.place(df, ["asset_id"], "timestamp_utc", limit)
        assert placed.count() == df.count()
        sizes = placed.groupBy("asset_id", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_utc").alias("a"), F.max("timestamp_utc").alias("b")).collect()
        busiest = df.groupBy("asset_id", F.unix_seconds("timestamp_utc")).count().agg(F.max("count")).first()[0]
        assert max(r.n for r in sizes) <= limit + busiest
        assert max(r.n for r in sizes) <= 0.2 * df.count() or limit > 1000
        for asset in ("hot", "b"):
            own = sorted((r for r in sizes if r.asset_id == asset), key=lambda r: r._bucket)
            assert all(x.b < y.a for x, y in zip(own, own[1:], strict=False))
    nulls = df.limit(3).withColumn("timestamp_utc", F.lit(None).cast("timestamp"))
    assert {r._bucket for r in series.place(nulls, ["asset_id"], "timestamp_utc").collect()} == {None}
    assert series.place(df.limit(0), ["asset_id"], "timestamp_utc").count() == 0


def test_equal_results_on_a_hot_series(spark, monkeypatch):
    df = hot_table(spark, 3000).dropDuplicates(["asset_id", "timestamp_utc"])
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    plain = rows(silver.fill_short_gaps(df, ["v"], bucket_seconds=10**9))
    frame = df.withColumnRenamed("v", "power_mw")
    lagged = lambda **o: rows(features.lags_and_rolling(frame, mode="time", lags={"l": 1}, window=3, min_periods=2, **o).withColumn("rolling_24h_mw", F.round("rolling_24h_mw", 6)))
    asked = df.select("asset_id", F.col("timestamp_utc").alias("at"), "n").filter("n % 7 = 0")
    match = lambda **o: rows(joins.nearest_asof(asked, df.filter("v IS NOT NULL"), ["asset_id"], "at", "timestamp_utc", ["v"], **o))
    whole = lagged(bucket_seconds=10**9), match(bucket_seconds=10**9)
    # small buckets from counts
    monkeypatch.setattr(series, "CHUNK_ROWS", 150)
    monkeypatch.setattr(series.splitters, "__defaults__", (150, 3600, True))
    assert rows(silver.fill_short_gaps(df, ["v"])) == plain
    assert (lagged(chunk_rows=150), match()) == whole


def test_time_halo_copies_a_row_once_at_most(spark):
    df = hot_table(spark)
    chunks = series.with_time_halo(df, "timestamp_utc", 1800, keys=["asset_id"], chunk_rows=200)
    copies = chunks.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.count_if(~F.col("_halo")).alias("own"))
    assert copies.agg(F.max("c")).first()[0] == 2 and copies.agg(F.min("own"), F.max("own")).first()[:] == (1, 1)
    assert copies.count() == df.count()


def test_nearest_asof_with_copies_nulls_and_clashing_names(spark):
    """Copies share one point of the time line; nulls of a series match nulls; the least payload of a time is taken."""
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    left = [("a", at(s), i, float(i)) for i, s in enumerate([10, 10, 10, 55, None])] + [(None, at(7), 9, 1.0), ("c", at(1), 10, 2.0)]
    right = [("a", at(0), 5.0, "x"), ("a", at(20), 4.0, "b"), ("a", at(20), 4.0, "a"), ("a", None, 0.0, "n"), (None, at(90), 8.0, "z")] + [("a", at(60), 7.0, "q")] * 300
    out = joins.nearest_asof(
        spark.createDataFrame(left, "k string, ts timestamp, n int, v double"), spark.createDataFrame(right, "k string, ts timestamp, v double, tag string"), ["k"], "ts", "ts", ["v", "tag"]
    )
    assert out.columns == ["k", "ts", "n", "v", "matched_ts", "matched_v", "matched_tag"]
    got = {r.n: (r.matched_ts, r.matched_v, r.matched_tag) for r in out.collect()}
    none = (None, None, None)
    assert got == {0: (at(0), 5.0, "x"), 1: (at(0), 5.0, "x"), 2: (at(0), 5.0, "x"), 3: (at(60), 7.0, "q"), 4: none, 9: (at(90), 8.0, "z"), 10: none}
    alone = joins.nearest_asof(out.select("k", "ts", "n"), out.where("n = 3").select("k", "ts"), ["k"], "ts", "ts", [])
    assert {r.n: r.matched_ts for r in alone.collect()} == {n: at(55) if n < 4 else None for n in (0, 1, 2, 3, 4, 9, 10)}
    assert joins.nearest_asof(out.select("k", "ts").limit(0), out.select("k", "ts", "v"), ["k"], "ts", "ts", ["v"]).count() == 0


def test_nearest_asof_sorts_times_alone(spark):
    left = spark.range(50).selectExpr("'a' AS k", "timestamp_seconds(id * 7) AS ts", "id AS n", "repeat('x', 99) AS wide")
    right = spark.range(50).selectExpr("'a' AS k", "timestamp_seconds(id * 11) AS rts", "id AS s", "id AS unused")
    plan = joins.nearest_asof(left, right, ["k"], "ts", "rts", ["s"])._jdf.queryExecution()
    optimized = plan.optimizedPlan().toString()
    # both neighbours in one window; whole rows reach only the last join
    windows = [line for line in optimized.splitlines() if "lead(_offered" in line]
    assert len(windows) == 1 and "lag(_offered" in windows[0]
    assert "wide" not in optimized[optimized.index(windows[0][:60]):] and "unused" not in optimized.split("Aggregate")[0]
