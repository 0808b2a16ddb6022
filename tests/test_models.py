"""Training, intervals, scoring and recursive forecasts on a synthetic day cycle."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.operators import features, forecast, models
from voltmill.schemas import FEATURES

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def telemetry(spark):
    rows = []
    for asset, technology, capacity in (("s1", "solar", 50.0), ("s2", "solar", 80.0), ("w1", "wind", 60.0)):
        for i in range(24 * 40):
            at = START + dt.timedelta(hours=i)
            sun = max(0.0, math.sin(math.pi * (at.hour - 6) / 12))
            speed = 8 + 4 * math.sin(i / 9.0)
            expected = capacity * (sun if technology == "solar" else min(max((speed - 3) / 10, 0), 1))
            power = min(expected * (0.9 + 0.08 * math.sin(i * 1.7)), capacity)
            rows.append((asset, technology, at, capacity, power, expected, 0.97, 1000 * sun, 15 + 5 * sun, 0.2, speed, i))
    schema = (
        "asset_id string, technology string, timestamp_utc timestamp, installed_capacity_mw double, power_mw double,"
        " expected_power_mw double, availability double, irradiance_wm2 double, temperature_c double,"
        " cloud_cover_fraction double, wind_speed_ms double, event_sequence long"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def training(telemetry):
    return models.train_forecasters(features.build_features(telemetry), ["ridge", "random_forest"], sizes=models.QUICK)


def test_training_ranks_candidates_and_beats_persistence(training):
    ranked = forecast.rank_models(training.metrics).collect()
    assert {(r.technology, r.selection_rank) for r in ranked} == {
        (t, k) for t in ("solar", "wind") for k in (1, 2)
    }
    for row in ranked:
        if row.selection_rank == 1:
            assert training.champions[row.technology].name == row.model
            assert row.skill_vs_persistence > 0
        assert 0.6 <= row.coverage_p10_p90 <= 1.0


def test_intervals_are_ordered_and_bounded(training):
    rows = training.evaluation
    bad = rows.filter(
        (F.col("p10_mw") > F.col("p50_mw")) | (F.col("p50_mw") > F.col("p90_mw"))
        | (F.col("p10_mw") < 0) | (F.col("p90_mw") > F.col("installed_capacity_mw"))
    )
    assert rows.count() > 0 and bad.count() == 0


def test_holdout_is_the_last_fourteen_days(telemetry):
    split = forecast.holdout_split(features.build_features(telemetry))
    assert split.filter("is_test").agg(F.min("timestamp_utc")).first()[0] == START + dt.timedelta(hours=24 * 40 - 1, days=-14)
    assert split.filter(F.col("lag_168h_mw").isNull()).count() == 0


def test_folds_keep_a_gap(telemetry):
    folds = forecast.time_folds(telemetry, 3, 24)
    edges = folds.groupBy("technology", "fold").agg(
        F.max(F.when(F.col("role") == "fit", F.unix_seconds("timestamp_utc"))).alias("fit_end"),
        F.min(F.when(F.col("role") == "validate", F.unix_seconds("timestamp_utc"))).alias("val_start"),
    )
    for row in edges.collect():
        assert row.val_start - row.fit_end >= 24 * 3600


@pytest.mark.parametrize("name", ["ridge", "random_forest", "extra_trees", "gradient_boosting"])
def test_exported_arrays_predict_like_the_model(spark, telemetry, name):
    rows = features.build_features(telemetry).filter((F.col("technology") == "wind") & F.col("lag_168h_mw").isNotNull())
    fitted = models.fit(rows, "wind", name, models.candidates(sizes=models.QUICK)[name])
    exported = models.export_model(fitted, spark)
    sample = rows.orderBy("timestamp_utc").limit(40)
    scored = fitted.transform(sample).orderBy("timestamp_utc").collect()
    for row in scored:
        mine = models.predict_arrays(exported, np.array([row[c] for c in FEATURES], dtype=float))
        assert min(max(mine, 0.0), row.installed_capacity_mw) == pytest.approx(row.point_mw, abs=1e-6)


def test_recursive_forecast(telemetry, training):
    future = models.forecast_recursive(telemetry, training.champions, training.offsets)
    rows = future.orderBy("asset_id", "horizon_hours").collect()
    assert len(rows) == 3 * 48
    assert rows[0].timestamp_utc == START + dt.timedelta(hours=24 * 40)
    for row in rows:
        assert 0 <= row.p10_mw <= row.p50_mw <= row.p90_mw <= row.installed_capacity_mw
        if row.technology == "solar" and (row.timestamp_utc.hour <= 6 or row.timestamp_utc.hour >= 18):
            assert row.adjusted_point_mw == row.p90_mw == 0.0
    noon = [r for r in rows if r.asset_id == "s1" and r.timestamp_utc.hour == 12]
    assert all(35 <= r.adjusted_point_mw <= 50 for r in noon)


def test_batch_scoring_needs_an_approval(spark, telemetry, training):
    requests = features.build_features(telemetry).filter(F.col("lag_168h_mw").isNotNull()).withColumn(
        "lag_1h_mw", F.lit(0.0)
    )
    filled = models.fill_request_lags(requests)
    assert filled.filter(F.col("lag_1h_mw") != F.col("lag_24h_mw")).count() == 0
    approvals = spark.createDataFrame(
        [("solar", training.champions["solar"].name, "approved"), ("wind", "other", "approved")],
        "technology string, model string, approval_status string",
    )
    scored = models.score_batch(requests, training.champions, training.offsets, approvals)
    reasons = {(r.technology, r.rejection) for r in scored.select("technology", "rejection").distinct().collect()}
    assert reasons == {("solar", None), ("wind", "MODEL_ARTIFACT_MISMATCH")}
    inside = scored.filter("rejection IS NULL").filter(~F.col("p50_mw").between(F.col("p10_mw"), F.col("p90_mw")))
    assert inside.count() == 0
    none = models.score_batch(requests, training.champions, training.offsets, approvals.limit(0))
    assert none.filter("rejection = 'MODEL_NOT_APPROVED'").count() == requests.count()


def test_challenger(spark, telemetry):
    row = models.train_challenger(telemetry.withColumn("quality_flag", F.lit("valid")), trees=10).first()
    assert row.mae_mw < 10 and row.dataset_hash.startswith("sha256:")
