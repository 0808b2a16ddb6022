"""Nearest-station, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill.functions.physics import EARTH_RADIUS_KM, haversine_km
from voltmill.operators.series import bucketed_rows, carry_bounds
from voltmill.session import epoch_bucket, materialize


def _cells(lat: str, lon: str, size_km: float) -> list:
    """Cell of a place in a cubic grid around the globe (no poles, no date line)."""
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(axis * (EARTH_RADIUS_KM / size_km)).cast("long") for axis in axes]


def nearest_station(
    points: DataFrame,
    stations: DataFrame,
    max_km: float = 100.0,
    rings: Sequence[float] = (64.0, 8.0, 1.0),
    point_id: str = "point_id",
) -> DataFrame:
    """Nearest station of every point, or NULL beyond ``max_km``.

    Places are put on cubic grids of growing cell size (``max_km`` divided by
    each ring). A station within one cell size always lies in the 27 cells
    around the point, so a hit no farther than the cell size is final; only
    points without one go on to the next, coarser grid. Equal coordinates are
    searched once, and candidates are reduced before they are shuffled.
    """
    places = points.select("latitude", "longitude").distinct().filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    sites = stations.groupBy("latitude", "longitude").agg(F.min("station_id").alias("station_id"))
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    found, open_places = None, places
    for ring in rings:
        size = max_km / ring
        x, y, z = _cells("latitude", "longitude", size)
        spread = (
            sites.withColumns({"_x0": x, "_y0": y, "_z0": z})
            .withColumn("_dx", F.explode(steps))
            .withColumn("_dy", F.explode(steps))
            .withColumn("_dz", F.explode(steps))
            .select(
                (F.col("_x0") + F.col("_dx")).alias("_x"),
                (F.col("_y0") + F.col("_dy")).alias("_y"),
                (F.col("_z0") + F.col("_dz")).alias("_z"),
                "station_id",
                F.col("latitude").alias("_slat"),
                F.col("longitude").alias("_slon"),
            )
        )
        distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_slat"), F.col("_slon"))
        best = (
            open_places.withColumns({"_x": x, "_y": y, "_z": z})
            .join(spread, ["_x", "_y", "_z"])
            .withColumn("_km", distance)
            .filter(F.col("_km") <= size)
            .groupBy("latitude", "longitude")
            .agg(F.min(F.struct("_km", "station_id")).alias("_best"))
        )
        found = best if found is None else found.unionByName(best)
        if ring != rings[-1]:
            open_places = open_places.join(best, ["latitude", "longitude"], "left_anti")
    return points.join(found, ["latitude", "longitude"], "left").select(
        *points.columns,
        F.col("_best.station_id").alias("station_id"),
        F.col("_best._km").alias("distance_km"),
    )


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    tolerance_seconds: int | None = None,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """For every left row the right row closest in time; the earlier one on a tie.

    Only series and times are put on one time line, each pair once however
    many rows share it, so copies cost nothing there. The line is cut per
    series into buckets of about ``CHUNK_ROWS`` points, unless
    ``bucket_seconds`` fixes their length; one sort of a bucket gives both
    neighbours, and bucket summaries give those beyond its edges. Rows meet
    their match afterwards, by series and time. Among right rows of one series
    and time the least payload is taken. A row without a time matches nothing.
    """
    by = list(by)
    points = lambda df, ts, is_right: df.select(*by, F.col(ts).alias("_time"), F.lit(is_right).alias("_right")).where(F.col("_time").isNotNull())
    both = points(left, left_ts, False).unionByName(points(right, right_ts, True))
    asked, offered = F.bool_or(~F.col("_right")), F.max(F.when(F.col("_right"), F.col("_time")))
    # written, as it is counted, summed up and sorted
    line = materialize(both.groupBy(*by, "_time").agg(asked.alias("_asked"), offered.alias("_offered")), "time-line")
    line = bucketed_rows(line, by, "_time", bucket_seconds)
    bounds = carry_bounds(line, by, "_time", {"_edge": F.col("_offered")}).select(
        *(F.col(k).alias(f"_e_{k}") for k in by), F.col("_bucket").alias("_e_bucket"), "_edge_before", "_edge_after"
    )
    series = ", ".join(f"`{k}`" for k in by)
    neighbour = lambda side: F.expr(f"{side}(_offered, 1) IGNORE NULLS OVER (PARTITION BY {series}, _bucket ORDER BY _time)")
    placed = line.withColumns({"_before": neighbour("lag"), "_after": neighbour("lead")}).where("_asked")
    same = [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in by]
    known = placed.join(bounds, [*same, F.col("_bucket") == F.col("_e_bucket")], "left")
    before, after = F.coalesce("_offered", "_before", "_edge_before"), F.coalesce("_offered", "_after", "_edge_after")
    micros = F.unix_micros
    back, ahead = micros("_time") - micros(before), micros(after) - micros("_time")
    at = F.when(after.isNull() | (back <= ahead), before).otherwise(after)
    if tolerance_seconds is not None:
        at = F.when(F.least(back, ahead) <= tolerance_seconds * 1_000_000, at)
    hits = known.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_time").alias("_asked_at"), at.alias("matched_ts"))
    fetched = hits
    if payload:
        stored = (
            right.groupBy(*(F.col(k).alias(f"_r_{k}") for k in by), F.col(right_ts).alias("_at"))
            .agg(F.min(F.struct(*payload)).alias("_match"))
            .select(*(f"_r_{k}" for k in by), "_at", *(F.col(f"_match.{c}").alias(f"matched_{c}") for c in payload))
        )
        fetched = hits.join(stored, [*(F.col(f"_k_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in by), F.col("matched_ts") == F.col("_at")], "left")
    own = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    return left.join(fetched, [*own, F.col(left_ts) == F.col("_asked_at")], "left").select(*left.columns, "matched_ts", *(f"matched_{c}" for c in payload))


def label_intervals(
    telemetry: DataFrame,
    windows: DataFrame,
    ts: str = "timestamp_utc",
    key: str = "asset_id",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Readings inside scenario windows [window_start, window_end) of their asset.

    Windows are listed under every time bucket they touch, so the join is an
    equi-join on (asset, bucket) with the range test on top; a busy asset is
    spread over its buckets.
    """
    first = epoch_bucket("window_start", bucket_seconds)
    last = F.floor((F.unix_micros("window_end") - 1) / F.lit(1_000_000 * bucket_seconds)).cast("long")
    spread = windows.filter(F.col("window_end") > F.col("window_start")).withColumn(
        "_bucket", F.explode(F.sequence(first, last))
    )
    return (
        telemetry.withColumn("_bucket", epoch_bucket(ts, bucket_seconds))
        .join(spread, [key, "_bucket"])
        .filter((F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end")))
        .drop("_bucket")
    )


# Scenarios that need one technology, their detectors and actions.
SCENARIO_TECHNOLOGY = {"soiling": "solar", "inverter_loss": "solar", "wind_vibration": "wind"}
SCENARIO_DETECTION = {
    "soiling": ("Residual + Isolation Forest", "Schedule thermographic inspection"),
    "inverter_loss": ("Physical production rule", "Verify inverter alarms"),
    "wind_vibration": ("Robust vibration score", "Plan safe maintenance window"),
    "source_outage": ("Freshness SLA", "Serve last-valid snapshot"),
    "model_drift": ("nMAE + PSI monitor", "Train challenger; require approval"),
}
SCENARIO_LOSS_SHARE = 0.18


def dedup_requests(requests: DataFrame, keys: Sequence[str] = ("scenario", "asset_id", "seed")) -> DataFrame:
    """One row per idempotency key: the first request by id."""
    first = F.min_by(F.struct(*[F.col(c) for c in requests.columns if c not in keys]), "request_id")
    return requests.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")


def scenario_impact(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Expected loss per scenario request; rejected requests carry a reason."""
    from voltmill.functions.text import lookup

    scenario = F.col("scenario")
    required = lookup(scenario, SCENARIO_TECHNOLOGY)
    known = scenario.isin(*SCENARIO_DETECTION)
    joined = requests.join(
        assets.select("asset_id", F.col("technology").alias("_technology"), "capacity_mw"), "asset_id", "left"
    )
    rejection = (
        F.when(~known | scenario.isNull(), "unknown scenario")
        .when(F.col("_technology").isNull(), "unknown asset")
        .when(~F.col("severity").between(1, 100), "severity out of range")
        .when(~F.col("duration_hours").between(1, 168), "duration out of range")
        .when(
            required.isNotNull() & (required != F.col("_technology")),
            F.concat(F.lit("requires a "), required, F.lit(" asset")),
        )
    )
    run_key = F.concat_ws(":", scenario, "asset_id", F.col("seed").cast("string"))
    loss = (
        F.col("capacity_mw") * F.col("duration_hours") * F.col("severity") / 100 * SCENARIO_LOSS_SHARE
    )
    ok = F.col("rejection").isNull()
    return joined.withColumn("rejection", rejection).select(
        *requests.columns,
        "rejection",
        F.when(ok, F.concat(F.lit("scn-"), F.sha2(run_key, 256))).alias("run_id"),
        F.when(ok, lookup(scenario, {k: v[0] for k, v in SCENARIO_DETECTION.items()})).alias("detected_by"),
        F.when(ok, lookup(scenario, {k: v[1] for k, v in SCENARIO_DETECTION.items()})).alias("action"),
        F.when(
            ok, F.greatest(F.lit(9), 74 - F.floor(F.col("severity") / 2))
        ).alias("detection_seconds"),
        F.when(ok, loss).alias("estimated_mwh_at_risk"),
    )
