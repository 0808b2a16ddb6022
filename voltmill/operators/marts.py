"""Gold marts, portfolio summaries and their joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.functions.text import technology_label
from voltmill.operators.filters import recent
from voltmill.schemas import RENEWABLE

# Parameters of the published marts.
BAND_FLOOR_MW = 9.0
BAND_SHARE = 0.19
DEMAND_FACTOR = 2.8
DEMAND_BASE_MW = 460.0
SEVERITIES = ("critical", "high", "medium", "low")
INSPECTION_CLASSES = ("normal", "microcrack", "hotspot", "soiling")


def portfolio_hourly(silver: DataFrame, include_battery: bool = True) -> DataFrame:
    """Hour x technology mart over valid rows.

    Rows are first combined per (hour, technology, asset) on the map side, so
    the exact asset count needs no extra pass over the readings.
    """
    rows = silver.filter(F.col("quality_flag") == "valid")
    if not include_battery:
        rows = rows.filter(F.col("technology") != "battery")
    per_asset = rows.groupBy(
        F.date_trunc("hour", "timestamp_utc").alias("date_hour"), "technology", "asset_id"
    ).agg(
        F.sum("energy_mwh").alias("energy"),
        F.sum("power_mw").alias("actual"),
        F.sum("expected_power_mw").alias("expected"),
        F.sum("availability").alias("availability_sum"),
        F.count("availability").alias("availability_n"),
        F.sum("price_eur_mwh").alias("price_sum"),
        F.count("price_eur_mwh").alias("price_n"),
    )
    return (
        per_asset.groupBy("date_hour", "technology")
        .agg(
            F.sum("energy").alias("energy_mwh"),
            F.sum("actual").alias("actual_mw"),
            F.sum("expected").alias("expected_mw"),
            _ratio(F.sum("availability_sum"), F.sum("availability_n")).alias("availability"),
            _ratio(F.sum("price_sum"), F.sum("price_n")).alias("price_eur_mwh"),
            F.count("asset_id").alias("asset_count"),
        )
        .withColumn("mwh_at_risk", shortfall("expected_mw", "actual_mw"))
    )


def _ratio(total: Column, count: Column) -> Column:
    return F.try_divide(total, count)


def shortfall(expected: str, actual: str) -> Column:
    """Positive part of expected minus actual; NULL if either is missing."""
    gap = F.col(expected) - F.col(actual)
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def portfolio_series(telemetry: DataFrame, n: int = 96, days: int = 7) -> DataFrame:
    """Newest ``n`` hourly totals with an uncertainty band."""
    hourly = (
        recent(telemetry, days)
        .filter(F.col("technology").isin(*RENEWABLE))
        .groupBy("timestamp_utc")
        .agg(F.sum("power_mw").alias("actual"), F.sum("expected_power_mw").alias("forecast"))
        .orderBy(F.col("timestamp_utc").desc())
        .limit(n)
    )
    band = hourly.agg(
        F.greatest(
            F.lit(BAND_FLOOR_MW), F.coalesce(F.stddev_samp("actual"), F.lit(0.0)) * BAND_SHARE
        ).alias("band")
    ).scalar()
    return hourly.withColumn("_band", band).select(
        "timestamp_utc",
        "actual",
        "forecast",
        F.greatest(F.col("forecast") - F.col("_band"), F.lit(0.0)).alias("p10"),
        (F.col("forecast") + F.col("_band")).alias("p90"),
    )


def asset_summary(telemetry: DataFrame, days: int = 7) -> DataFrame:
    """Per-asset totals of the last days."""
    return recent(telemetry, days).groupBy("asset_id").agg(
        F.avg("availability").alias("availability"),
        F.sum("energy_mwh").alias("actual_mwh"),
        F.sum("expected_power_mw").alias("expected_mwh"),
        F.avg("price_eur_mwh").alias("price"),
    )


def latest_by_asset(
    df: DataFrame,
    columns: Sequence[str] = ("power_mw",),
    ts: str = "timestamp_utc",
    tiebreak: str = "event_sequence",
) -> DataFrame:
    """Newest reading per asset, combined on the map side."""
    newest = F.max_by(F.struct(ts, *columns), F.struct(ts, tiebreak))
    return df.groupBy("asset_id").agg(newest.alias("_r")).select("asset_id", "_r.*")


def sparkline(
    df: DataFrame,
    n: int = 20,
    value: str = "power_mw",
    ts: str = "timestamp_utc",
    tiebreak: str = "event_sequence",
) -> DataFrame:
    """Last ``n`` values per asset in time order.

    ``row_number <= n`` is applied before the shuffle too, so at most ``n``
    rows per asset and map task are moved and collected.
    """
    newest = Window.partitionBy("asset_id").orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    kept = (
        df.select("asset_id", ts, tiebreak, value)
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("k"), F.col(value).alias("v"))))
    return kept.groupBy("asset_id").agg(F.transform(ordered, lambda x: x["v"]).alias("sparkline"))


def asset_rows(
    assets: DataFrame, telemetry: DataFrame, incidents: DataFrame | None = None, days: int = 7
) -> DataFrame:
    """Catalogue with latest reading, weekly summary, risk and sparkline."""
    summary = asset_summary(telemetry, days)
    latest = latest_by_asset(telemetry).select(
        "asset_id", F.col("power_mw").alias("current_power_mw")
    )
    rows = (
        assets.join(summary, "asset_id", "left")
        .join(latest, "asset_id", "left")
        .join(sparkline(telemetry), "asset_id", "left")
    )
    if incidents is not None:
        risk = incidents.groupBy("asset_id").agg(F.sum("mwh_at_risk").alias("mwh_at_risk"))
        rows = rows.join(risk, "asset_id", "left")
    else:
        rows = rows.withColumn("mwh_at_risk", F.lit(0.0))
    zero = lambda column: F.coalesce(column, F.lit(0.0))
    return rows.select(
        *assets.columns,
        technology_label(F.col("technology")).alias("technology_label"),
        zero(F.col("current_power_mw")).alias("current_power_mw"),
        zero(F.col("availability") * 100).alias("availability"),
        zero(F.col("actual_mwh") / (F.col("capacity_mw") * 24 * days) * 100).alias("capacity_factor"),
        zero(F.col("expected_mwh") / days).alias("forecast_24h_mwh"),
        zero(F.col("mwh_at_risk")).alias("mwh_at_risk"),
        zero(F.col("actual_mwh") * F.col("price")).alias("revenue_7d_eur"),
        "sparkline",
    )


def energy_mix(telemetry: DataFrame, days: int = 7) -> DataFrame:
    """Energy per technology and its share of the positive total."""
    totals = (
        recent(telemetry, days)
        .groupBy("technology")
        .agg(F.greatest(F.sum("energy_mwh"), F.lit(0.0)).alias("energy_mwh"))
    )
    # one row per technology, so the unpartitioned window is tiny
    whole = F.sum("energy_mwh").over(Window.partitionBy(F.lit(1)))
    return totals.withColumn(
        "share", F.when(whole > 0, F.col("energy_mwh") / whole * 100).otherwise(F.lit(0.0))
    )


def market_hourly(telemetry: DataFrame, n: int = 120, days: int = 7) -> DataFrame:
    """Newest ``n`` market hours."""
    return (
        recent(telemetry, days)
        .groupBy("timestamp_utc")
        .agg(
            F.avg("price_eur_mwh").alias("price"),
            F.sum("power_mw").alias("generation"),
            (F.sum("expected_power_mw") * DEMAND_FACTOR + DEMAND_BASE_MW).alias("demand"),
        )
        .orderBy(F.col("timestamp_utc").desc())
        .limit(n)
    )


def capture_rates(telemetry: DataFrame, days: int = 7) -> DataFrame:
    """Capture price and rate per technology and for the portfolio."""
    rows = recent(telemetry, days).filter(F.col("technology").isin(*RENEWABLE))
    hourly = rows.groupBy("timestamp_utc").agg(F.avg("price_eur_mwh").alias("hour_price"))
    reference = hourly.agg(F.avg("hour_price").alias("reference_price")).scalar()
    energy = F.when(F.col("energy_mwh").isNotNull(), F.greatest("energy_mwh", F.lit(0.0)))
    return (
        rows.rollup("technology")
        .agg(
            F.sum(F.col("price_eur_mwh") * energy).alias("_value"),
            F.sum(energy).alias("_energy"),
        )
        .withColumn("_reference", reference)
        .select(
            F.coalesce("technology", F.lit("portfolio")).alias("technology"),
            (F.col("_value") / F.greatest("_energy", F.lit(1e-9))).alias("capture_price"),
            F.col("_reference").alias("reference_price"),
        )
        .withColumn(
            "capture_rate",
            100 * F.col("capture_price") / F.greatest("reference_price", F.lit(1e-9)),
        )
    )


def kpis(
    assets: DataFrame,
    telemetry: DataFrame,
    incidents: DataFrame,
    forecast: DataFrame | None = None,
    champions: DataFrame | None = None,
    now: Column | None = None,
    days: int = 7,
) -> DataFrame:
    """One row of headline figures, each a scalar subquery."""
    week = recent(telemetry, days)
    energy = F.greatest("energy_mwh", F.lit(0.0))
    weekly = week.agg(
        F.sum(F.when(F.col("energy_mwh").isNotNull(), energy) * F.col("price_eur_mwh")).alias("revenue_7d_eur"),
        (F.avg("availability") * 100).alias("availability"),
        F.max("timestamp_utc").alias("data_through"),
    )
    scalar = lambda df, column: df.agg(column.alias("v")).scalar()
    # one pass over each frame: its figures travel as one struct
    fleet = F.struct(F.count_if(F.col("status") == "online").alias("online"), F.count(F.lit(1)).alias("total"))
    active = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("mwh_at_risk"), F.lit(0.0)).alias("mwh"))
    weekly = weekly.withColumns({"_fleet": scalar(assets, fleet), "_active": scalar(incidents, active)})
    columns = {
        "assets_online": F.col("_fleet.online"),
        "assets_total": F.col("_fleet.total"),
        "active_anomalies": F.col("_active.n"),
        "mwh_at_risk": F.col("_active.mwh"),
    }
    if forecast is not None:
        columns["forecast_24h_mwh"] = scalar(
            forecast.filter(F.col("horizon_hours") <= 24), F.sum("p50_mw")
        )
    if champions is not None:
        columns["forecast_nmae"] = scalar(champions, F.avg("nmae") * 100)
    result = weekly.withColumns(columns).drop("_fleet", "_active")
    clock = now if now is not None else F.current_timestamp()
    minutes = F.floor((F.unix_seconds(clock) - F.unix_seconds("data_through")) / 60)
    return result.withColumn("data_freshness_minutes", F.greatest(minutes, F.lit(0)))


def price_kpis(market: DataFrame) -> DataFrame:
    """Mean price, negative hours and generation-weighted price."""
    return market.agg(
        F.avg("price").alias("average_price"),
        F.count_if(F.col("price") < 0).alias("negative_hours"),
        F.try_divide(F.sum(F.col("price") * F.col("generation")), F.sum("generation")).alias(
            "capture_price"
        ),
    )


def price_duration(market: DataFrame) -> DataFrame:
    """Prices from high to low; the market frame is already bounded."""
    ranked = Window.partitionBy(F.lit(1)).orderBy(F.col("price").desc(), F.col("timestamp_utc"))
    return market.select("timestamp_utc", "price", F.row_number().over(ranked).alias("hour_rank"))


def fleet_totals(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.sum("capacity_mw").alias("capacity_mw"),
        F.sum(F.greatest("current_power_mw", F.lit(0.0))).alias("current_power_mw"),
        F.avg("availability").alias("availability"),
        F.sum("revenue_7d_eur").alias("revenue_7d_eur"),
    )


def class_histogram(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Count per class, zero for classes without rows; rows of no known class count as ``other``."""
    spark = df.sparkSession
    domain = spark.createDataFrame(
        [(name, position) for position, name in enumerate([*classes, "other"])], f"{column} string, position int"
    )
    known = F.when(F.col(column).isin(*classes), F.col(column)).otherwise("other")
    counts = df.groupBy(known.alias(column)).agg(F.count(F.lit(1)).alias("n"))
    # the domain is a fixed short list
    return (
        F.broadcast(domain)
        .join(counts, column, "left")
        .select(column, "position", F.coalesce("n", F.lit(0)).alias("n"))
    )


def severity_counts(incidents: DataFrame) -> DataFrame:
    return class_histogram(incidents, "severity", SEVERITIES)


def class_counts(inspections: DataFrame, column: str = "label") -> DataFrame:
    return class_histogram(inspections, column, INSPECTION_CLASSES)


def incident_matrix(incidents: DataFrame) -> DataFrame:
    """Incidents per severity and cause."""
    return incidents.groupBy("severity", "labelled_cause").agg(F.count(F.lit(1)).alias("n"))


def technology_profile(df: DataFrame) -> DataFrame:
    """Rows, assets and mean power per technology."""
    per_asset = df.groupBy("technology", "asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("power_mw").alias("s"), F.count("power_mw").alias("c")
    )
    return per_asset.groupBy("technology").agg(
        F.sum("n").alias("row_count"),
        F.count("asset_id").alias("asset_count"),
        F.try_divide(F.sum("s"), F.sum("c")).alias("mean_power_mw"),
    )


def describe_columns(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.01, 0.5, 0.99)
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles per column."""
    from voltmill.operators.quantiles import exact_quantiles

    long = unpivot(df, columns, "measure", "value")
    moments = long.groupBy("measure").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quantiles = exact_quantiles(long, ["measure"], "value", probs, bounded_groups=True)
    wide = quantiles.groupBy("measure").agg(
        *[
            F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(f"p{int(round(p * 100))}")
            for p in probs
        ]
    )
    return moments.join(wide, "measure", "left")


def unpivot(
    df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Long form: one row per input row and column."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), name, value
    )


def forecast_by_technology(future: DataFrame) -> DataFrame:
    """Hourly sums of P10/P50/P90; sums of quantiles are not portfolio quantiles."""
    return future.groupBy("timestamp_utc", "technology").agg(
        *[F.sum(c).alias(c) for c in ("p10_mw", "p50_mw", "p90_mw")]
    )


def ops_counters(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.sum("energy_mwh").alias("energy_mwh"),
        F.sum("mwh_at_risk").alias("mwh_at_risk"),
        F.avg("availability").alias("availability"),
    )


def generation_trend(gold: DataFrame) -> DataFrame:
    return gold.groupBy(F.date_trunc("hour", "date_hour").alias("date_hour")).agg(
        F.sum("actual_mw").alias("actual_mw"), F.sum("expected_mw").alias("expected_mw")
    )


def metric_nmae(evaluation: DataFrame, forecast: str = "p50_mw") -> DataFrame:
    """Governed nMAE per asset-day, horizon and model version; valid rows only."""
    rows = evaluation
    if "quality_flag" in evaluation.columns:
        rows = rows.filter(F.col("quality_flag") == "valid")
    error = F.abs(F.col("power_mw") - F.col(forecast)) / F.col("installed_capacity_mw")
    return rows.groupBy(
        "asset_id",
        "technology",
        F.date_trunc("day", "timestamp_utc").alias("day"),
        "horizon_hours",
        "model_version",
    ).agg(F.avg(error).alias("nmae"))


def metric_mwh_at_risk(silver: DataFrame) -> DataFrame:
    """Governed MWh at risk per asset-hour, curtailed rows left out."""
    return (
        silver.filter(~F.coalesce("curtailment_flag", F.lit(False)))
        .groupBy("asset_id", F.date_trunc("hour", "timestamp_utc").alias("date_hour"))
        .agg(F.sum(shortfall("expected_power_mw", "energy_mwh")).alias("mwh_at_risk"))
    )


def risk_matrix(risks: DataFrame) -> DataFrame:
    """Number of risks per likelihood and impact, with the worst level."""
    return risks.groupBy("likelihood", "impact").agg(
        F.count(F.lit(1)).alias("n"), F.min("risk_id").alias("first_risk_id")
    )



def evidence_counts(checks: DataFrame) -> DataFrame:
    """Passed and total checks over rows (check_id, passed)."""
    return checks.agg(
        F.count_if("passed").alias("checks_passed"),
        F.count(F.lit(1)).alias("checks_total"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
    )


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    tolerance: float = 1e-6,
) -> DataFrame:
    """Per key: largest difference, and keys present on one side only."""
    a = left.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures], F.lit(True).alias("_b"))
    gaps = [F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")) for m in measures]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return a.join(b, list(keys), "full_outer").select(
        *keys,
        F.when(F.col("_a").isNull(), "right_only")
        .when(F.col("_b").isNull(), "left_only")
        .when(F.coalesce(gap, F.lit(0.0)) < tolerance, "match")
        .otherwise("differs")
        .alias("outcome"),
        gap.alias("max_difference"),
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.max("max_difference").alias("max_difference")
    )


def source_rows(registry: DataFrame, status: DataFrame) -> DataFrame:
    """Source catalogue with the observed state; absent sources were not run."""
    observed = status.select(
        "source_id",
        F.col("status").alias("_status"),
        F.col("records").alias("_records"),
        F.col("checksum").alias("checksum"),
        F.col("extracted_at").alias("extracted_at"),
    )
    state = F.coalesce("_status", F.lit("not_run"))
    return registry.join(observed, "source_id", "left").select(
        *registry.columns,
        F.when(state == "success", "verified").otherwise(state).alias("status"),
        F.coalesce("_records", F.lit(0)).cast("long").alias("records"),
        "checksum",
        "extracted_at",
    )


def evidence_status(
    labels: DataFrame, evidence: DataFrame, success: str, missing: str, wanted: str
) -> DataFrame:
    """Label rows (id, name) with the state their evidence (id, state) supports."""
    return labels.join(evidence, "id", "left").select(
        *labels.columns,
        F.when(F.col("state") == wanted, success).otherwise(missing).alias("status"),
        *[c for c in evidence.columns if c not in ("id", "state")],
    )


def register_views(spark, gold: DataFrame) -> list[str]:
    """Operations and semantic views over Gold."""
    columns = [
        "date_hour",
        "technology",
        "energy_mwh",
        "actual_mw",
        "expected_mw",
        "availability",
        "price_eur_mwh",
        "mwh_at_risk",
        "asset_count",
    ]
    from voltmill.operators.filters import semantic_metrics

    gold.select(*columns).createOrReplaceTempView("v_operations_overview")
    semantic_metrics(gold).createOrReplaceTempView("v_semantic_metrics")
    return ["v_operations_overview", "v_semantic_metrics"]
