"""Model training, scoring and recursive forecasts with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.functions.physics import clip
from voltmill.operators import trees as histogram_trees
from voltmill.operators.forecast import (
    forecast_metrics,
    holdout_split,
    pinball,
    repair_quantiles,
    time_folds,
)
from voltmill.operators.joins import nearest_asof
from voltmill.operators.quantiles import exact_quantiles
from voltmill.schemas import FEATURES, RENEWABLE
from voltmill.session import materialize, new_path

SEED = 20260728
# The interval probabilities, the forecast length and the share
# of capacity below which a solar plant counts as dark.
PROBS = (0.1, 0.5, 0.9)
HOURS = 48
NIGHT_SHARE = 0.002
#: Assets that a task forecasts together.
ASSETS_AT_ONCE = 256


@dataclass(frozen=True)
class Sizes:
    """Trees and depths of both forests, rounds and leaves of boosting."""

    forest: tuple[int, int] = (70, 16)
    extra: tuple[int, int] = (70, 18)
    boosting: tuple[int, int] = (130, 24)


#: Sizes that train in seconds, for the registered queries.
QUICK = Sizes((40, 10), (40, 10), (12, 16))

#: A learner gets training rows, names of its columns and of the label, and returns a model as arrays.
Learner = Callable[[DataFrame, Sequence[str], str], dict]


def candidates(seed: int = SEED, sizes: Sizes = Sizes()) -> dict[str, list | Learner]:  # noqa: B008 - frozen
    """Estimator stages, or a learner on histograms, per candidate."""
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    linear = dict(featuresCol="features", labelCol="power_mw", predictionCol="prediction", maxIter=200)
    tree = dict(featuresCol="raw", labelCol="power_mw", predictionCol="prediction", seed=seed)
    return {
        "ridge": [scale, LinearRegression(regParam=0.01, elasticNetParam=0.0, **linear)],
        "elastic_net": [scale, LinearRegression(regParam=0.015, elasticNetParam=0.2, **linear)],
        "random_forest": [
            RandomForestRegressor(
                numTrees=sizes.forest[0], maxDepth=sizes.forest[1], minInstancesPerNode=3, featureSubsetStrategy="0.8", **tree
            )
        ],
        "extra_trees": lambda rows, columns, label: histogram_trees.extra_trees(
            rows, columns, label, *sizes.extra, min_leaf=3, share=0.8, seed=seed
        ),
        "gradient_boosting": lambda rows, columns, label: histogram_trees.boost(
            rows, columns, label, sizes.boosting[0], 0.07, sizes.boosting[1], l2=0.4
        )[0],
    }


@dataclass
class Fitted:
    """A fitted candidate of one technology."""

    technology: str
    name: str
    model: PipelineModel | dict
    medians: dict[str, float]
    columns: Sequence[str] = field(default=FEATURES)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``point_mw``, limited to [0, capacity]."""
        filled = df.select(
            "*", *[F.coalesce(c, F.lit(self.medians[c])).alias(f"_x_{c}") for c in self.columns]
        )
        inputs = [f"_x_{c}" for c in self.columns]
        if isinstance(self.model, dict):
            scored = histogram_trees.with_predictions(filled, {"prediction": self.model}, inputs)
        else:
            scored = self.model.transform(filled)
        return scored.withColumn(
            "point_mw", clip(F.col("prediction"), 0.0, F.col("installed_capacity_mw"))
        ).drop("raw", "features", "prediction", *[f"_x_{c}" for c in self.columns])


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians: one number per feature column, so collecting is bounded."""
    from voltmill.operators.marts import unpivot

    rows = exact_quantiles(
        unpivot(df, columns), ["feature"], "value", [0.5], bounded_groups=True
    ).collect()
    found = {row.feature: row.quantile for row in rows}
    return {c: float(found.get(c) or 0.0) for c in columns}


def fit(
    train: DataFrame, technology: str, name: str, stages: list | Learner, columns: Sequence[str] = FEATURES,
    medians: dict[str, float] | None = None,
) -> Fitted:
    """Fit one candidate on rows with a known power."""
    known = train.filter(F.col("power_mw").isNotNull())
    medians = medians or column_medians(known, columns)
    filled = known.select(
        "power_mw", *[F.coalesce(c, F.lit(medians[c])).alias(f"_x_{c}") for c in columns]
    )
    if callable(stages):
        return Fitted(technology, name, stages(filled, [f"_x_{c}" for c in columns], "power_mw"), medians, columns)
    assemble = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="raw")
    model = Pipeline(stages=[assemble, *stages]).fit(filled)
    return Fitted(technology, name, model, medians, columns)


def validate(
    train: DataFrame, technology: str, name: str, stages: list, medians: dict[str, float],
    folds: int = 3, gap_hours: int = 24,
) -> tuple[float, DataFrame]:
    """Mean absolute error over rolling-origin folds, and the rows scored there."""
    folded = time_folds(train.filter(F.col("power_mw").isNotNull()), folds, gap_hours)
    parts = []
    for fold in range(1, folds + 1):
        rows = folded.filter(F.col("fold") == fold)
        fitted = fit(rows.filter(F.col("role") == "fit"), technology, name, stages, medians=medians)
        parts.append(fitted.transform(rows.filter(F.col("role") == "validate")))
    scored = _union(parts).select("technology", "timestamp_utc", "fold", "power_mw", "point_mw")
    errors = scored.groupBy("fold").agg(F.avg(F.abs(F.col("power_mw") - F.col("point_mw"))).alias("m"))
    mean = errors.agg(F.avg("m").alias("m")).first().m
    return (float("inf") if mean is None else float(mean)), scored


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def conformal_quantiles(
    scored: DataFrame, probs: Sequence[float] = PROBS
) -> DataFrame:
    """Residual quantiles per (technology, hour): 24 rows per technology.

    An hour takes the residuals of itself and of both neighbours, so thin hours
    do not give thin intervals; an hour without any takes its technology's.
    """
    residual = scored.filter(F.col("power_mw").isNotNull()).select(
        "technology",
        F.hour("timestamp_utc").alias("hour"),
        (F.col("power_mw") - F.col("point_mw")).alias("residual"),
    )
    near = residual.withColumn(
        "hour", F.explode(F.transform(F.array(F.lit(23), F.lit(0), F.lit(1)), lambda step: (F.col("hour") + step) % 24))
    )
    wide = lambda frame, by, prefix: (
        exact_quantiles(frame, by, "residual", probs, bounded_groups=True)
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(f"{prefix}{int(p * 100)}")
                for p in probs
            ]
        )
    )
    hours = residual.groupBy("technology").agg(F.count(F.lit(1)).alias("_all")).select(
        "technology", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    )
    # two technologies and 24 hours: all of these are a few dozen rows
    return (
        hours.join(wide(near, ["technology", "hour"], "_h"), ["technology", "hour"], "left")
        .join(wide(residual, ["technology"], "_t"), "technology")
        .select(
            "technology",
            "hour",
            *[
                F.coalesce(f"_h{int(p * 100)}", f"_t{int(p * 100)}").alias(f"_q{int(p * 100)}")
                for p in probs
            ],
        )
    )


def quantile_intervals(scored: DataFrame, offsets: DataFrame) -> DataFrame:
    """P10/P50/P90 around the point forecast, ordered and inside [0, capacity]."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shifted = (
        scored.withColumn("hour", F.hour("timestamp_utc"))
        .join(F.broadcast(offsets), ["technology", "hour"], "left")
        .withColumns(
            {
                "p10_mw": F.col("point_mw") + zero("_q10"),
                "p50_mw": F.col("point_mw") + zero("_q50"),
                "p90_mw": F.col("point_mw") + zero("_q90"),
            }
        )
        .drop("hour", "_q10", "_q50", "_q90")
    )
    return repair_quantiles(shifted)


@dataclass(frozen=True)
class QuantileSizes:
    """Rounds, rate, depth and smallest leaf of the quantile ensembles."""

    rounds: int = 80
    rate: float = 0.06
    depth: int = 3
    min_leaf: int = 8


def train_quantiles(
    features: DataFrame, days: int = 14, probs: Sequence[float] = PROBS, sizes: QuantileSizes = QuantileSizes(),  # noqa: B008 - frozen
) -> DataFrame:
    """Holdout rows with ``p10_mw``, ``p50_mw`` and ``p90_mw`` of ensembles fitted to pinball loss.

    One ensemble for each probability and technology, all fitted on the rows before the holdout. ``was_crossed`` marks
    rows whose raw quantiles were out of order; the repaired ones are ordered and inside [0, capacity].
    """
    split = materialize(holdout_split(features, days), "split")
    names = [f"p{int(p * 100)}_mw" for p in probs]

    def scored(technology: str) -> DataFrame:
        own = split.filter((F.col("technology") == technology) & F.col("power_mw").isNotNull())
        train = own.filter(~F.col("is_test"))
        medians = column_medians(train, FEATURES)
        inputs = [f"_x_{c}" for c in FEATURES]
        filled = own.withColumns({x: F.coalesce(c, F.lit(medians[c])) for x, c in zip(inputs, FEATURES, strict=True)})
        found = histogram_trees.boost(
            filled.filter(~F.col("is_test")), inputs, "power_mw", sizes.rounds, sizes.rate, None, sizes.depth, sizes.min_leaf, alphas=probs
        )
        holdout = filled.filter(F.col("is_test"))
        return histogram_trees.with_predictions(holdout, dict(zip(names, found, strict=True)), inputs).drop(*inputs)

    with ThreadPoolExecutor(len(RENEWABLE)) as pool:
        return repair_quantiles(_union(list(pool.map(inheritable_thread_target(scored), RENEWABLE))))


def quantile_report(scored: DataFrame, probs: Sequence[float] = PROBS) -> DataFrame:
    """Per technology: rows, coverage and width of the outer interval, raw crossings and pinball loss of each quantile."""
    names = [f"p{int(p * 100)}_mw" for p in probs]
    low, high = F.col(names[0]), F.col(names[-1])
    loss = lambda p, c: F.avg(pinball(F.col("power_mw"), F.col(c), p))
    return scored.groupBy("technology").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.avg(F.col("power_mw").between(low, high).cast("double")).alias("coverage"),
        F.avg(high - low).alias("mean_width_mw"),
        F.avg(F.col("was_crossed").cast("double")).alias("crossing_rate"),
        *(loss(p, c).alias(f"pinball_{c[:-3]}") for p, c in zip(probs, names, strict=True)),
    )


@dataclass
class Training:
    """Champions per technology, metric rows of all candidates, evaluation rows."""

    champions: dict[str, Fitted]
    offsets: DataFrame
    metrics: DataFrame
    evaluation: DataFrame


def train_forecasters(
    features: DataFrame, names: Sequence[str] | None = None, days: int = 14, folds: int = 3,
    gap_hours: int = 24, seed: int = SEED, parallelism: int = 5, sizes: Sizes = Sizes(),  # noqa: B008 - frozen
) -> Training:
    """Train all candidates per technology and keep the best on validation.

    The holdout is read only for the final metrics. The interval offsets are
    the champion's residual quantiles on the validation folds, rows it was not
    fitted on. All candidates are scored against the champion's interval.
    """
    split = materialize(holdout_split(features, days), "split")
    stages = candidates(seed, sizes)
    train = {t: split.filter((F.col("technology") == t) & ~F.col("is_test")) for t in RENEWABLE}
    medians = {t: column_medians(rows, FEATURES) for t, rows in train.items()}

    def attempt(task: tuple[str, str]) -> tuple[float, Fitted, DataFrame]:
        technology, name = task
        arguments = (train[technology], technology, name, stages[name], medians[technology])
        score, scored = validate(*arguments, folds, gap_hours)
        return score, fit(*arguments[:4], medians=arguments[4]), scored

    # the fits are independent Spark jobs, so several are submitted at a time
    tasks = [(technology, name) for technology in RENEWABLE for name in names or stages]
    with ThreadPoolExecutor(parallelism) as pool:
        fits = list(pool.map(inheritable_thread_target(attempt), tasks))
    champions: dict[str, Fitted] = {}
    unseen: dict[str, DataFrame] = {}
    for _, fitted, scored in sorted(fits, key=lambda item: item[0]):
        champions.setdefault(fitted.technology, fitted)
        unseen.setdefault(fitted.technology, scored)

    offsets = materialize(conformal_quantiles(_union(list(unseen.values()))), "interval-offsets")
    evaluation = materialize(
        quantile_intervals(_by_technology(champions, split.filter(F.col("is_test"))), offsets), "evaluation"
    )
    rows = []
    for score, fitted, _ in fits:
        test = evaluation.filter(F.col("technology") == fitted.technology).drop("point_mw")
        rows.append(
            forecast_metrics(fitted.transform(test), ("technology",), point="point_mw").withColumns(
                {
                    "model": F.lit(fitted.name),
                    "validation_mae_mw": F.lit(score),
                    "validation_folds": F.lit(folds),
                    "validation_gap_hours": F.lit(gap_hours),
                }
            )
        )
    return Training(champions, offsets, materialize(_union(rows), "metrics"), evaluation)


def _by_technology(champions: dict[str, Fitted], rows: DataFrame) -> DataFrame:
    return _union(
        [
            fitted.transform(rows.filter(F.col("technology") == technology)).withColumn(
                "model", F.lit(fitted.name)
            )
            for technology, fitted in champions.items()
        ]
    )


def fill_request_lags(requests: DataFrame) -> DataFrame:
    """Missing or zero short and weekly lags fall back to the daily lag."""
    falsy = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    return requests.withColumns(
        {
            c: F.when(falsy(c), F.col("lag_24h_mw")).otherwise(F.col(c))
            for c in ("lag_1h_mw", "lag_168h_mw")
        }
    )


def score_batch(
    requests: DataFrame, champions: dict[str, Fitted], offsets: DataFrame, approvals: DataFrame | None = None
) -> DataFrame:
    """Score forecast requests; requests without an approved model or a daily lag carry a reason.

    P50 is the point forecast where it lies inside [P10, P90].
    """
    ready = fill_request_lags(requests)
    scored = quantile_intervals(_by_technology(champions, ready), offsets)
    inside = F.col("point_mw").between(F.col("p10_mw"), F.col("p90_mw"))
    scored = scored.withColumn("p50_mw", F.when(inside, F.col("point_mw")).otherwise(F.col("p50_mw")))
    outputs = ("point_mw", "p10_mw", "p50_mw", "p90_mw")
    lagless = F.when(F.col("lag_24h_mw").isNull(), F.lit("MISSING_DAILY_LAG"))
    if approvals is None:
        return scored.withColumn("rejection", lagless).withColumns({c: F.when(F.col("rejection").isNull(), F.col(c)) for c in outputs})
    granted = approvals.filter(F.col("approval_status") == "approved").select(
        "technology", F.col("model").alias("_approved")
    )
    joined = scored.join(granted, "technology", "left")
    reason = F.when(F.col("_approved").isNull(), "MODEL_NOT_APPROVED").when(
        F.col("_approved") != F.col("model"), "MODEL_ARTIFACT_MISMATCH"
    )
    return (
        joined.withColumn("rejection", F.coalesce(reason, lagless))
        .withColumns({c: F.when(F.col("rejection").isNull(), F.col(c)) for c in outputs})
        .drop("_approved")
    )


# --- recursive forecast ---

FUTURE_SCHEMA = (
    "timestamp_utc timestamp, asset_id string, technology string, horizon_hours int,"
    " raw_point_mw double, adjusted_point_mw double, installed_capacity_mw double"
)


def export_model(fitted: Fitted, spark) -> dict:
    """A fitted model as plain arrays, small enough to travel with a function."""
    medians = np.array([fitted.medians[c] for c in fitted.columns])
    if isinstance(fitted.model, dict):
        return fitted.model | {"medians": medians}
    stage = fitted.model.stages[-1]
    if hasattr(stage, "coefficients"):
        scaler = fitted.model.stages[-2]
        deviation = scaler.std.toArray()
        factor = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        weights = stage.coefficients.toArray() * factor
        return {
            "kind": "linear",
            "medians": medians,
            "weights": weights,
            "intercept": float(stage.intercept - np.dot(weights, scaler.mean.toArray())),
        }
    path = new_path(spark, "model")
    stage.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    trees = []
    for _, tree in nodes.groupby("treeID"):
        tree = tree.sort_values("id")
        trees.append(
            {
                "feature": np.array([s["featureIndex"] for s in tree["split"]]),
                "threshold": np.array(
                    [s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else 0.0
                     for s in tree["split"]]
                ),
                "left": tree["leftChild"].to_numpy(),
                "right": tree["rightChild"].to_numpy(),
                "value": tree["prediction"].to_numpy(),
            }
        )
    weights = np.array(stage.treeWeights)
    return {"kind": "trees", "medians": medians, "trees": trees, "weights": weights / weights.sum(), "base": 0.0}


def predict_arrays(model: dict, rows: np.ndarray) -> np.ndarray:
    """Predictions of feature rows from exported arrays, all rows of a step at once."""
    x = np.atleast_2d(rows)
    x = np.where(np.isnan(x), model["medians"], x)
    if model["kind"] == "linear":
        return x @ model["weights"] + model["intercept"]
    return histogram_trees.predict(model, x)


def forecast_inputs(telemetry: DataFrame, hours: int = HOURS) -> DataFrame:
    """Bounded per-asset inputs: the last 168 hours and one weather row per target hour.

    Weather of a target hour is the reading nearest to one week earlier; the
    issue time is the newest reading of the whole portfolio.
    """
    rows = telemetry.filter(F.col("technology").isin(*RENEWABLE))
    issue = rows.agg(F.max("timestamp_utc").alias("m")).scalar()
    latest = rows.groupBy("asset_id").agg(
        F.max_by(F.struct("technology", "installed_capacity_mw", "power_mw"), "timestamp_utc").alias("_l")
    )
    targets = (
        latest.withColumn("_issue", issue)
        .withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(hours))))
        .withColumn("target_ts", F.col("_issue") + F.make_dt_interval(hours=F.col("horizon_hours")))
        .withColumn("_reference", F.col("target_ts") - F.expr("INTERVAL 7 DAYS"))
        .select("asset_id", "horizon_hours", "target_ts", "_reference", "_l.technology",
                "_l.installed_capacity_mw", F.col("_l.power_mw").alias("last_power_mw"))
    )
    weather = ["irradiance_wm2", "temperature_c", "cloud_cover_fraction", "wind_speed_ms",
               "availability", "expected_power_mw", "power_mw"]
    right = rows.select("asset_id", F.col("timestamp_utc").alias("_rts"), *weather)
    future = nearest_asof(targets, right, ["asset_id"], "_reference", "_rts", weather)
    history = (
        rows.withColumn("_issue", issue)
        .filter(F.col("timestamp_utc") > F.col("_issue") - F.expr("INTERVAL 168 HOURS"))
        .join(latest.select("asset_id", F.col("_l.technology").alias("_now")), "asset_id")
        .select("asset_id", F.col("_now").alias("technology"), F.col("timestamp_utc").alias("target_ts"), "power_mw", F.lit(0).alias("horizon_hours"))
    )
    return future.drop("_reference", "matched_ts").withColumn("power_mw", F.lit(None).cast("double")).unionByName(
        history, allowMissingColumns=True
    )


def _roll(models: dict[str, dict], hours: int):
    """Forecast of a group of assets of one technology, hour by hour for all of them together."""
    weather = ["irradiance_wm2", "temperature_c", "cloud_cover_fraction", "wind_speed_ms", "availability"]

    def roll(pdf: pd.DataFrame) -> pd.DataFrame:
        technology = pdf["technology"].dropna().iloc[0]
        targets = pdf[pdf["horizon_hours"] > 0].sort_values(["asset_id", "horizon_hours"])
        past = pdf[(pdf["horizon_hours"] == 0) & pdf["power_mw"].notna()]
        assets = targets["asset_id"].unique()
        place = {asset: i for i, asset in enumerate(assets)}
        first = targets["target_ts"].min()
        # one week of readings up to the issue hour, then the forecast
        known = np.full((len(assets), 168 + hours), np.nan)
        back = (first - past["target_ts"]).dt.total_seconds().to_numpy()
        usable = (back % 3600 == 0) & (back <= 168 * 3600) & (back > 0)
        rows = past["asset_id"].map(place).to_numpy(dtype=float)
        usable &= ~np.isnan(rows)
        known[rows[usable].astype(int), 168 - (back[usable] // 3600).astype(int)] = past["power_mw"].to_numpy(dtype=float)[usable]
        grid = lambda column: targets[column].to_numpy(dtype=float).reshape(len(assets), hours)
        columns = {c: grid(f"matched_{c}") for c in (*weather, "power_mw", "expected_power_mw")}
        last, capacity = grid("last_power_mw")[:, 0], grid("installed_capacity_mw")[:, 0]
        times = targets["target_ts"].iloc[:hours]
        raw_points = np.empty((len(assets), hours))
        for step in range(hours):
            at, now = times.iloc[step], 168 + step
            lag = lambda h, other, now=now: np.where(np.isnan(known[:, now - h]), other, known[:, now - h])
            day = known[:, now - 24 : now]
            seen = (~np.isnan(day)).sum(axis=1)
            mean = np.where(seen > 0, np.nansum(day, axis=1) / np.maximum(seen, 1), np.nan)
            calendar = (
                np.sin(2 * np.pi * at.hour / 24),
                np.cos(2 * np.pi * at.hour / 24),
                np.sin(2 * np.pi * at.dayofyear / 365.25),
                np.cos(2 * np.pi * at.dayofyear / 365.25),
            )
            week_before = columns["power_mw"][:, step]
            x = np.column_stack(
                [
                    *(np.full(len(assets), c) for c in calendar),
                    *(columns[c][:, step] for c in weather),
                    lag(1, last),
                    lag(24, week_before),
                    lag(168, week_before),
                    mean,
                ]
            )
            raw = predict_arrays(models[technology], x)
            adjusted = np.clip(raw, 0.0, capacity)
            if technology == "solar":
                adjusted[columns["expected_power_mw"][:, step] <= capacity * NIGHT_SHARE] = 0.0
            raw_points[:, step] = raw
            known[:, now] = adjusted
        return pd.DataFrame(
            {
                "timestamp_utc": targets["target_ts"].to_numpy(),
                "asset_id": targets["asset_id"].to_numpy(),
                "technology": technology,
                "horizon_hours": targets["horizon_hours"].to_numpy(),
                "raw_point_mw": raw_points.ravel(),
                "adjusted_point_mw": known[:, 168:].ravel(),
                "installed_capacity_mw": targets["installed_capacity_mw"].to_numpy(),
            }
        )

    return roll


def forecast_recursive(
    telemetry: DataFrame, champions: dict[str, Fitted], offsets: DataFrame, hours: int = HOURS,
    version: str = "1.0.0",
) -> DataFrame:
    """Recursive 1 to ``hours`` ahead forecast per asset with intervals.

    Every step needs the step before it, so an asset runs in one task, on at
    most 168 hourly readings and ``hours`` target rows. Groups of about
    ``ASSETS_AT_ONCE`` assets run in parallel, each step for a whole group.
    ``telemetry`` holds one reading per asset and hour (Silver).
    """
    spark = telemetry.sparkSession
    models = {technology: export_model(fitted, spark) for technology, fitted in champions.items()}
    names = F.create_map(*[F.lit(x) for t, f in champions.items() for x in (t, f.name)])
    inputs = forecast_inputs(telemetry, hours)
    fleet = telemetry.agg(F.approx_count_distinct("asset_id")).first()[0]
    part = F.pmod(F.xxhash64("asset_id"), F.lit(1 + fleet // ASSETS_AT_ONCE)).alias("part")
    rolled = inputs.groupBy("technology", part).applyInPandas(_roll(models, hours), FUTURE_SCHEMA)
    banded = quantile_intervals(rolled.withColumn("point_mw", F.col("adjusted_point_mw")), offsets)
    # a dark solar hour has no spread either
    dark = (F.col("technology") == "solar") & (F.col("adjusted_point_mw") == 0)
    return (
        banded.withColumns(
            {c: F.when(dark, F.lit(0.0)).otherwise(F.col(c)) for c in ("p10_mw", "p50_mw", "p90_mw")}
        )
        .withColumns({"model_name": names[F.col("technology")], "model_version": F.lit(version), "is_synthetic": F.lit(True)})
        .drop("point_mw", "was_crossed")
    )


# Inputs of the portfolio challenger.
CHALLENGER_FEATURES = (
    "installed_capacity_mw",
    "irradiance_wm2",
    "temperature_c",
    "cloud_cover_fraction",
    "wind_speed_ms",
    "availability",
)


def train_challenger(silver: DataFrame, days: int = 14, trees: int = 120, depth: int = 30) -> DataFrame:
    """One model for the whole portfolio on raw features; its holdout error as one row."""
    from voltmill.operators.governance import content_hash

    rows = materialize(
        silver.filter(F.col("technology").isin(*RENEWABLE) & (F.col("quality_flag") == "valid"))
        .filter(F.col("power_mw").isNotNull())
        .select("timestamp_utc", "asset_id", "technology", "power_mw", *CHALLENGER_FEATURES),
        "challenger",
    )
    cutoff = rows.agg((F.max("timestamp_utc") - F.expr(f"INTERVAL {int(days)} DAYS")).alias("c")).scalar()
    marked = rows.withColumn("is_test", F.col("timestamp_utc") >= cutoff)
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=3, featureSubsetStrategy="0.8",
        bootstrap=False, featuresCol="raw", labelCol="power_mw", predictionCol="prediction", seed=SEED,
    )
    fitted = fit(marked.filter(~F.col("is_test")), "portfolio", "portfolio_challenger", [forest], CHALLENGER_FEATURES)
    scored = fitted.transform(marked.filter(F.col("is_test")))
    hashes = content_hash(rows, ["timestamp_utc", "asset_id", "power_mw"])
    return scored.agg(
        F.avg(F.abs(F.col("power_mw") - F.col("point_mw"))).alias("mae_mw"),
        F.count(F.lit(1)).alias("test_rows"),
    ).withColumns(
        {
            "model": F.lit("portfolio_challenger"),
            "dataset_hash": hashes.select("content_hash").scalar(),
            "promotion_status": F.lit("pending_manual_approval"),
        }
    )
