"""Feature, join, physics and storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.functions import physics
from voltmill.operators import features, joins, quantiles, storage
from voltmill.plans.registry import query
from voltmill.plans.telemetry import ASSETS_SQL, SILVER_SQL, TELEMETRY_SQL

CALENDAR_SQL = """sin(2 * pi() * extract(hour FROM timestamp_utc) / 24) AS hour_sin,
    cos(2 * pi() * extract(hour FROM timestamp_utc) / 24) AS hour_cos,
    sin(2 * pi() * extract(doy FROM timestamp_utc) / CAST(365.25 AS DOUBLE)) AS day_sin,
    cos(2 * pi() * extract(doy FROM timestamp_utc) / CAST(365.25 AS DOUBLE)) AS day_cos"""

FEATURES_SQL = (
    SILVER_SQL
    + f""",
features AS (
  SELECT *, {CALENDAR_SQL},
    lag(power_mw, 1) OVER s AS lag_1h_mw, lag(power_mw, 24) OVER s AS lag_24h_mw, lag(power_mw, 168) OVER s AS lag_168h_mw,
    CASE WHEN count(power_mw) OVER r >= 6 THEN avg(power_mw) OVER r END AS rolling_24h_mw
  FROM silver
  WINDOW s AS (PARTITION BY asset_id ORDER BY timestamp_utc),
         r AS (PARTITION BY asset_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
)"""
)
FEATURE_SPEC = (
    "asset_id:s timestamp_utc:t hour_sin:r hour_cos:r day_sin:r day_cos:r lag_1h_mw:d lag_24h_mw:d"
    " lag_168h_mw:d rolling_24h_mw:d"
)


@query("features", FEATURE_SPEC, f"WITH {FEATURES_SQL} SELECT * FROM features")
def _(t):
    # small chunks here, so the halo is exercised at every scale
    return features.build_features(t.silver, chunk_rows=200)


@query(
    "features_time",
    FEATURE_SPEC,
    f"""WITH {SILVER_SQL} SELECT s.*, {CALENDAR_SQL.replace('timestamp_utc', 's.timestamp_utc')},
      a.power_mw AS lag_1h_mw, b.power_mw AS lag_24h_mw, c.power_mw AS lag_168h_mw,
      CASE WHEN count(s.power_mw) OVER r >= 6 THEN avg(s.power_mw) OVER r END AS rolling_24h_mw
    FROM silver s
      LEFT JOIN silver a ON a.asset_id = s.asset_id AND a.timestamp_utc = s.timestamp_utc - INTERVAL 1 HOUR
      LEFT JOIN silver b ON b.asset_id = s.asset_id AND b.timestamp_utc = s.timestamp_utc - INTERVAL 24 HOUR
      LEFT JOIN silver c ON c.asset_id = s.asset_id AND c.timestamp_utc = s.timestamp_utc - INTERVAL 168 HOUR
    WINDOW r AS (PARTITION BY s.asset_id ORDER BY s.timestamp_utc
                 RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING)""",
)
def _(t):
    return features.build_features(t.silver, mode="time", bucket_seconds=8 * 86_400)


@query(
    "energy_integral",
    "asset_id:s timestamp_utc:t interval_hours:d energy_integral_mwh:d",
    f"""WITH {SILVER_SQL}, timed AS (
      SELECT *, epoch(timestamp_utc - lag(timestamp_utc) OVER (PARTITION BY asset_id ORDER BY timestamp_utc)) / 3600 AS interval_hours FROM silver)
    SELECT asset_id, timestamp_utc, interval_hours, power_mw * interval_hours AS energy_integral_mwh FROM timed""",
)
def _(t):
    return features.integrate_energy(t.silver, chunk_rows=200)


@query(
    "capacity_ratio",
    "asset_id:s timestamp_utc:t capacity_ratio:r",
    f"WITH {SILVER_SQL} SELECT asset_id, timestamp_utc, power_mw / installed_capacity_mw AS capacity_ratio FROM silver",
)
def _(t):
    return features.capacity_ratio(t.silver)


@query(
    "exact_quantiles",
    "technology:s prob:r quantile:d",
    f"""WITH {TELEMETRY_SQL} """
    + " UNION ALL ".join(
        f"SELECT technology, CAST({p} AS DOUBLE) AS prob, quantile_cont(power_mw, {p}) AS quantile FROM telemetry GROUP BY technology"
        for p in (0.0, 0.1, 0.3, 0.5, 0.7, 0.982, 1.0)
    ),
)
def _(t):
    return quantiles.exact_quantiles(
        t.telemetry, ["technology"], "power_mw", [0.0, 0.1, 0.3, 0.5, 0.7, 0.982, 1.0], bounded_groups=True
    )


@query(
    "lineitem_quantiles",
    "l_returnflag:s prob:r quantile:d",
    " UNION ALL ".join(
        f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS prob, quantile_cont(l_extendedprice, {p}) AS quantile FROM lineitem GROUP BY 1"
        for p in (0.1, 0.5, 0.9)
    ),
)
def _(t):
    return quantiles.exact_quantiles(
        t.read("lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.9], bounded_groups=True
    )


@query(
    "asset_percentiles",
    "asset_id:s day:t p30:d p70:d",
    f"""WITH {SILVER_SQL} SELECT asset_id, date_trunc('day', timestamp_utc) AS day, quantile_cont(price_eur_mwh, 0.3) AS p30,
      quantile_cont(price_eur_mwh, 0.7) AS p70 FROM silver GROUP BY 1, 2""",
)
def _(t):
    daily = t.silver.withColumn("day", F.date_trunc("day", "timestamp_utc"))
    return quantiles.group_percentiles(daily, ["asset_id", "day"], "price_eur_mwh", [0.3, 0.7]).select(
        "asset_id", "day", F.col("quantiles")[0].alias("p30"), F.col("quantiles")[1].alias("p70")
    )


PLACES_SQL = """points AS (
  SELECT c_custkey AS point_id, 36 + CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(125 AS DOUBLE) AS latitude,
    -9 + CAST(c_custkey * 91 % 1000 AS DOUBLE) / CAST(80 AS DOUBLE) AS longitude FROM customer
),
stations AS (
  SELECT 'st-' || CAST(s_suppkey AS VARCHAR) AS station_id, 36 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / CAST(125 AS DOUBLE) AS latitude,
    -9 + CAST(s_suppkey * 29 % 1000 AS DOUBLE) / CAST(80 AS DOUBLE) AS longitude FROM supplier
)"""


def points(t):
    key = F.col("c_custkey")
    return t.read("customer").select(
        key.alias("point_id"),
        (36 + (key * 37 % 1000).cast("double") / F.lit(125.0)).alias("latitude"),
        (-9 + (key * 91 % 1000).cast("double") / F.lit(80.0)).alias("longitude"),
    )


def stations(t):
    key = F.col("s_suppkey")
    return t.read("supplier").select(
        F.concat(F.lit("st-"), key.cast("string")).alias("station_id"),
        (36 + (key * 53 % 1000).cast("double") / F.lit(125.0)).alias("latitude"),
        (-9 + (key * 29 % 1000).cast("double") / F.lit(80.0)).alias("longitude"),
    )


HAVERSINE_SQL = """2 * CAST(6371.0088 AS DOUBLE) * atan2(sqrt(a), sqrt(1 - a))"""


@query(
    "nearest_station",
    "point_id:i station_id:s distance_km:d",
    f"""WITH {PLACES_SQL}, pairs AS (
      SELECT point_id, station_id, pow(sin((radians(s.latitude) - radians(p.latitude)) / 2), 2)
        + cos(radians(p.latitude)) * cos(radians(s.latitude)) * pow(sin((radians(s.longitude) - radians(p.longitude)) / 2), 2) AS a
      FROM points p CROSS JOIN stations s),
    near AS (SELECT point_id, station_id, {HAVERSINE_SQL} AS km FROM pairs
      QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, station_id) = 1)
    SELECT points.point_id, CASE WHEN km <= 40 THEN station_id END AS station_id, CASE WHEN km <= 40 THEN km END AS distance_km
    FROM points LEFT JOIN near ON points.point_id = near.point_id""",
)
def _(t):
    return joins.nearest_station(points(t), stations(t), max_km=40.0)


@query(
    "haversine",
    "point_id:i km:d",
    f"""WITH {PLACES_SQL}, parts AS (
      SELECT point_id, pow(sin((radians(CAST(40.4168 AS DOUBLE)) - radians(latitude)) / 2), 2)
        + cos(radians(latitude)) * cos(radians(CAST(40.4168 AS DOUBLE))) * pow(sin((radians(CAST(-3.7038 AS DOUBLE)) - radians(longitude)) / 2), 2) AS a
      FROM points) SELECT point_id, {HAVERSINE_SQL} AS km FROM parts""",
)
def _(t):
    km = physics.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(40.4168), F.lit(-3.7038))
    return points(t).select("point_id", km.alias("km"))


@query(
    "nearest_asof",
    "asset_id:s timestamp_utc:t matched_ts:t matched_temperature_c:d matched_expected_power_mw:d",
    f"""WITH {SILVER_SQL}, targets AS (SELECT asset_id, timestamp_utc, timestamp_utc - INTERVAL 7 DAY AS target FROM silver),
    best AS (
      SELECT l.asset_id, l.timestamp_utc, r.timestamp_utc AS matched_ts, r.temperature_c AS matched_temperature_c,
        r.expected_power_mw AS matched_expected_power_mw
      FROM targets l JOIN silver r ON l.asset_id = r.asset_id
      QUALIFY row_number() OVER (PARTITION BY l.asset_id, l.timestamp_utc
        ORDER BY abs(epoch(r.timestamp_utc - l.target)), r.timestamp_utc) = 1)
    SELECT * FROM best""",
)
def _(t):
    left = t.silver.select("asset_id", "timestamp_utc").withColumn(
        "target", F.col("timestamp_utc") - F.expr("INTERVAL 7 DAYS")
    )
    right = t.silver.select("asset_id", F.col("timestamp_utc").alias("rts"), "temperature_c", "expected_power_mw")
    return joins.nearest_asof(
        left, right, ["asset_id"], "target", "rts", ["temperature_c", "expected_power_mw"],
        bucket_seconds=2 * 86_400,
    )


WINDOWS_SQL = """windows AS (
  SELECT event_sequence AS window_id, asset_id, timestamp_utc AS window_start,
    timestamp_utc + to_hours(1 + event_sequence % 36) AS window_end,
    'scenario_' || CAST(event_sequence % 5 AS VARCHAR) AS scenario_id
  FROM telemetry WHERE event_sequence % 97 = 0
)"""


def scenario_windows(t):
    rows = t.telemetry.filter(F.col("event_sequence") % 97 == 0)
    hours = (1 + F.col("event_sequence") % 36).cast("int")
    return rows.select(
        F.col("event_sequence").alias("window_id"),
        "asset_id",
        F.col("timestamp_utc").alias("window_start"),
        (F.col("timestamp_utc") + F.make_dt_interval(hours=hours)).alias("window_end"),
        F.concat(F.lit("scenario_"), (F.col("event_sequence") % 5).cast("string")).alias("scenario_id"),
    )


@query(
    "interval_labels",
    "asset_id:s timestamp_utc:t window_id:i scenario_id:s",
    f"""WITH {SILVER_SQL}, {WINDOWS_SQL} SELECT s.asset_id, s.timestamp_utc, window_id, scenario_id
    FROM silver s JOIN windows w ON s.asset_id = w.asset_id AND s.timestamp_utc >= w.window_start AND s.timestamp_utc < w.window_end""",
)
def _(t):
    return joins.label_intervals(t.silver, scenario_windows(t))


REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id,
    CASE event_type WHEN 'error' THEN 'soiling' WHEN 'view' THEN 'inverter_loss' WHEN 'click' THEN 'wind_vibration'
      WHEN 'signup' THEN 'source_outage' ELSE 'model_drift' END AS scenario,
    'ast-' || lpad(CAST(user_id % 13 AS VARCHAR), 2, '0') AS asset_id, event_id % 40 AS seed,
    1 + event_id % 104 AS severity, 1 + event_id % 170 AS duration_hours FROM events
),
unique_requests AS (
  SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY scenario, asset_id, seed ORDER BY request_id) = 1
)"""


def scenario_requests(t):
    event, user = F.col("event_id"), F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "error", "soiling")
        .when(F.col("event_type") == "view", "inverter_loss")
        .when(F.col("event_type") == "click", "wind_vibration")
        .when(F.col("event_type") == "signup", "source_outage")
        .otherwise("model_drift")
    )
    return t.read("events").select(
        event.alias("request_id"),
        kind.alias("scenario"),
        F.format_string("ast-%02d", user % 13).alias("asset_id"),
        (event % 40).alias("seed"),
        (1 + event % 104).alias("severity"),
        (1 + event % 170).alias("duration_hours"),
    )


@query(
    "dedup_requests",
    "scenario:s asset_id:s seed:i request_id:i severity:i",
    f"WITH {REQUESTS_SQL} SELECT * FROM unique_requests",
)
def _(t):
    return joins.dedup_requests(scenario_requests(t))


@query(
    "scenario_impact",
    "request_id:i scenario:s asset_id:s rejection:s run_id:s detected_by:s detection_seconds:i estimated_mwh_at_risk:d",
    f"""WITH {ASSETS_SQL}, {REQUESTS_SQL}, checked AS (
      SELECT r.*, a.technology, a.capacity_mw,
        CASE WHEN a.technology IS NULL THEN 'unknown asset' WHEN severity NOT BETWEEN 1 AND 100 THEN 'severity out of range'
          WHEN duration_hours NOT BETWEEN 1 AND 168 THEN 'duration out of range'
          WHEN scenario IN ('soiling', 'inverter_loss') AND a.technology <> 'solar' THEN 'requires a solar asset'
          WHEN scenario = 'wind_vibration' AND a.technology <> 'wind' THEN 'requires a wind asset' END AS rejection
      FROM unique_requests r LEFT JOIN assets a ON r.asset_id = a.asset_id)
    SELECT request_id, scenario, asset_id, rejection,
      CASE WHEN rejection IS NULL THEN 'scn-' || sha256(scenario || ':' || asset_id || ':' || CAST(seed AS VARCHAR)) END AS run_id,
      CASE WHEN rejection IS NULL THEN CASE scenario WHEN 'soiling' THEN 'Residual + Isolation Forest' WHEN 'inverter_loss' THEN 'Physical production rule'
        WHEN 'wind_vibration' THEN 'Robust vibration score' WHEN 'source_outage' THEN 'Freshness SLA' ELSE 'nMAE + PSI monitor' END END AS detected_by,
      CASE WHEN rejection IS NULL THEN greatest(9, 74 - severity // 2) END AS detection_seconds,
      CASE WHEN rejection IS NULL THEN capacity_mw * duration_hours * severity / 100 * CAST(0.18 AS DOUBLE) END AS estimated_mwh_at_risk
    FROM checked""",
)
def _(t):
    return joins.scenario_impact(joins.dedup_requests(scenario_requests(t)), t.assets)


@query(
    "solar_expected",
    "event_sequence:i irradiance_ref_wm2:d expected_ref_mw:d",
    f"""WITH {TELEMETRY_SQL}, angles AS (
      SELECT event_sequence, installed_capacity_mw, temperature_c, cloud_cover_fraction, radians(36 + CAST(substr(asset_id, 5, 2) AS DOUBLE)) AS phi,
        radians(CAST(23.45 AS DOUBLE) * sin(2 * pi() * (284 + extract(doy FROM ingested_at)) / 365)) AS decl,
        radians(15 * (extract(hour FROM ingested_at) + extract(minute FROM ingested_at) / CAST(60 AS DOUBLE) - 12)) AS angle
      FROM telemetry WHERE technology = 'solar'),
    heights AS (SELECT *, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(angle) AS h FROM angles),
    sky AS (SELECT *, CASE WHEN h > 0 THEN 1098 * h * exp(CAST(-0.057 AS DOUBLE) / h) ELSE 0 END
        * (1 - CAST(0.75 AS DOUBLE) * pow(cloud_cover_fraction, CAST(3.4 AS DOUBLE))) AS irradiance_ref_wm2 FROM heights)
    SELECT event_sequence, irradiance_ref_wm2, installed_capacity_mw * irradiance_ref_wm2 / 1000
      * greatest(1 - CAST(0.0047 AS DOUBLE) * (temperature_c + irradiance_ref_wm2 * CAST(0.03125 AS DOUBLE) - 25), 0) * CAST(0.86 AS DOUBLE) AS expected_ref_mw FROM sky""",
)
def _(t):
    """Plants lie on latitudes by their numbers."""
    latitude = 36 + F.substring("asset_id", 5, 2).cast("double")
    sun = physics.solar_irradiance(F.col("ingested_at"), latitude, F.col("cloud_cover_fraction"))
    power = physics.solar_expected(
        F.col("installed_capacity_mw"), F.col("irradiance_ref_wm2"), F.col("temperature_c")
    )
    return (
        t.telemetry.filter(F.col("technology") == "solar")
        .withColumn("irradiance_ref_wm2", sun)
        .withColumn("expected_ref_mw", power)
    )


@query(
    "wind_expected",
    "event_sequence:i wind_speed_ms:d expected_ref_mw:d",
    f"""WITH {TELEMETRY_SQL} SELECT event_sequence, wind_speed_ms, CASE WHEN wind_speed_ms BETWEEN 3 AND 25 THEN installed_capacity_mw
      * least(greatest((pow(wind_speed_ms, 3) - 27) / (pow(CAST(12.5 AS DOUBLE), 3) - 27), 0), 1) ELSE 0 END AS expected_ref_mw
    FROM telemetry WHERE technology = 'wind'""",
)
def _(t):
    power = physics.wind_expected(F.col("installed_capacity_mw"), F.col("wind_speed_ms"))
    return t.telemetry.filter(F.col("technology") == "wind").withColumn("expected_ref_mw", power)


@query(
    "derived_signals",
    "event_sequence:i reactive_power_mvar:d module_temperature_c:d inverter_temperature_est_c:d dc_current_a:d",
    f"""WITH {TELEMETRY_SQL} SELECT event_sequence, power_mw * tan(acos(CAST(0.95 AS DOUBLE))) AS reactive_power_mvar,
      CASE WHEN technology = 'solar' THEN temperature_c + irradiance_wm2 * CAST(25 AS DOUBLE) / 800 END AS module_temperature_c,
      CASE WHEN technology = 'solar' AND power_mw IS NOT NULL THEN temperature_c + 25 * greatest(power_mw, 0) / installed_capacity_mw END AS inverter_temperature_est_c,
      CASE WHEN technology = 'solar' AND power_mw IS NOT NULL THEN greatest(power_mw, 0) * 1000 END AS dc_current_a
    FROM telemetry""",
)
def _(t):
    return physics.derived_signals(t.telemetry)


def weekly_requests(t, rows):
    """One battery request per plant and week over its hourly prices."""
    weekly = rows.withColumn("week", F.date_trunc("week", "timestamp_utc"))
    batteries = (
        weekly.select("asset_id", "week")
        .distinct()
        .withColumn("capacity_mwh", 10 + F.substring("asset_id", 5, 2).cast("double"))
        .withColumn("max_power_mw", F.lit(4.0))
    )
    return storage.dispatch_requests(weekly, batteries, ["asset_id", "week"])


PRICES_SQL = """prices AS (
  SELECT asset_id, date_trunc('week', timestamp_utc) AS week, price_eur_mwh AS p,
    row_number() OVER (PARTITION BY asset_id, date_trunc('week', timestamp_utc) ORDER BY timestamp_utc) AS h FROM silver
),
req AS (
  SELECT asset_id, week, 10 + CAST(substr(asset_id, 5, 2) AS DOUBLE) AS cap, quantile_cont(p, 0.3) AS lo, quantile_cont(p, 0.7) AS hi,
    sqrt(CAST(0.9 AS DOUBLE)) AS eff FROM prices GROUP BY asset_id, week HAVING count(*) <= 168
),
sim AS (
  SELECT asset_id, week, CAST(0 AS BIGINT) AS h, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS charge, CAST(0 AS DOUBLE) AS discharge,
    cap * CAST(0.5 AS DOUBLE) AS soc FROM req
  UNION ALL
  SELECT asset_id, week, h, p, charge, discharge, soc + charge * eff - discharge / eff FROM (
    SELECT s.asset_id, s.week, x.h, x.p, s.soc, r.eff,
      CASE WHEN x.p <= r.lo THEN least(CAST(4 AS DOUBLE), (r.cap - s.soc) / r.eff) ELSE CAST(0 AS DOUBLE) END AS charge,
      CASE WHEN x.p > r.lo AND x.p >= r.hi THEN least(CAST(4 AS DOUBLE), (s.soc - r.cap * CAST(0.1 AS DOUBLE)) * r.eff) ELSE CAST(0 AS DOUBLE) END AS discharge
    FROM sim s JOIN req r ON s.asset_id = r.asset_id AND s.week = r.week
      JOIN prices x ON x.asset_id = s.asset_id AND x.week = s.week AND x.h = s.h + 1)
)"""
STEPS_SQL = f"WITH RECURSIVE {SILVER_SQL}, {PRICES_SQL}"


@query(
    "battery_dispatch",
    "asset_id:s week:t horizon_hour:i price_eur_mwh:d charge_mw:d discharge_mw:d state_of_charge_mwh:d cashflow_eur:d",
    f"""{STEPS_SQL} SELECT asset_id, week, h AS horizon_hour, round_even(p, 4) AS price_eur_mwh, round_even(charge, 4) AS charge_mw,
      round_even(discharge, 4) AS discharge_mw, round_even(soc, 4) AS state_of_charge_mwh,
      round_even(discharge * p - charge * p, 2) AS cashflow_eur FROM sim WHERE h > 0""",
)
def _(t):
    return storage.battery_dispatch(weekly_requests(t, t.silver), ["asset_id", "week"])


@query(
    "battery_margin",
    "asset_id:s week:t estimated_margin_eur:d steps:i",
    f"""{STEPS_SQL} SELECT asset_id, week, round_even(sum(round_even(discharge * p - charge * p, 2)), 2) AS estimated_margin_eur,
      count(*) AS steps FROM sim WHERE h > 0 GROUP BY asset_id, week""",
)
def _(t):
    steps = storage.battery_dispatch(weekly_requests(t, t.silver), ["asset_id", "week"])
    return storage.dispatch_margin(steps, ["asset_id", "week"])


@query(
    "battery_rejects",
    "asset_id:s week:t rejection:s",
    f"""WITH {TELEMETRY_SQL} SELECT asset_id, date_trunc('week', timestamp_utc) AS week,
      'PRICE_COUNT' AS rejection FROM telemetry GROUP BY 1, 2 HAVING count(*) > 168""",
)
def _(t):
    return storage.dispatch_rejects(weekly_requests(t, t.telemetry), ["asset_id", "week"])
