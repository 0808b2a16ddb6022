"""Gold mart, filter and market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.functions import text
from voltmill.operators import filters, marts
from voltmill.plans.quality_queries import EVAL_SQL, evaluation
from voltmill.plans.registry import query
from voltmill.plans.telemetry import ASSETS_SQL, SILVER_SQL

RECENT_SQL = (
    SILVER_SQL
    + """,
recent AS (SELECT * FROM silver WHERE timestamp_utc >= (SELECT max(timestamp_utc) FROM silver) - INTERVAL 7 DAY)"""
)

GOLD_SQL = (
    SILVER_SQL
    + """,
gold AS (
  SELECT timestamp_utc AS date_hour, technology, sum(energy_mwh) AS energy_mwh, sum(power_mw) AS actual_mw,
    sum(expected_power_mw) AS expected_mw, avg(availability) AS availability, avg(price_eur_mwh) AS price_eur_mwh,
    count(DISTINCT asset_id) AS asset_count,
    CASE WHEN sum(power_mw) IS NOT NULL THEN greatest(sum(expected_power_mw) - sum(power_mw), 0) END AS mwh_at_risk
  FROM silver WHERE quality_flag = 'valid' GROUP BY 1, 2
)"""
)

GOLD_SPEC = (
    "date_hour:t technology:s energy_mwh:d actual_mw:d expected_mw:d availability:d"
    " price_eur_mwh:d asset_count:i mwh_at_risk:d"
)


@query("portfolio_hourly", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold")
def _(t):
    return marts.portfolio_hourly(t.silver)


@query(
    "portfolio_hourly_renewable",
    GOLD_SPEC,
    f"WITH {GOLD_SQL} SELECT * FROM gold WHERE technology <> 'battery'",
)
def _(t):
    return marts.portfolio_hourly(t.silver, include_battery=False)


@query(
    "portfolio_series",
    "timestamp_utc:t actual:d forecast:d p10:d p90:d",
    f"""WITH {RECENT_SQL}, hourly AS (
      SELECT timestamp_utc, sum(power_mw) AS actual, sum(expected_power_mw) AS forecast
      FROM recent WHERE technology IN ('solar', 'wind') GROUP BY 1 ORDER BY 1 DESC LIMIT 96),
    band AS (SELECT greatest(CAST(9 AS DOUBLE), stddev_samp(actual) * CAST(0.19 AS DOUBLE)) AS w FROM hourly)
    SELECT timestamp_utc, actual, forecast, greatest(forecast - w, 0) AS p10, forecast + w AS p90 FROM hourly, band""",
)
def _(t):
    return marts.portfolio_series(t.silver)


@query(
    "asset_summary",
    "asset_id:s availability:d actual_mwh:d expected_mwh:d price:d",
    f"""WITH {RECENT_SQL} SELECT asset_id, avg(availability) AS availability, sum(energy_mwh) AS actual_mwh,
      sum(expected_power_mw) AS expected_mwh, avg(price_eur_mwh) AS price FROM recent GROUP BY asset_id""",
)
def _(t):
    return marts.asset_summary(t.silver)


@query(
    "latest_by_asset",
    "asset_id:s timestamp_utc:t power_mw:d availability:d",
    f"""WITH {SILVER_SQL} SELECT asset_id, timestamp_utc, power_mw, availability FROM silver
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_utc DESC, event_sequence DESC) = 1""",
)
def _(t):
    return marts.latest_by_asset(t.silver, ["power_mw", "availability"])


SPARK_SQL = """lines AS (
  SELECT asset_id, string_agg(coalesce(CAST(CAST(round(power_mw * 100) AS BIGINT) AS VARCHAR), 'null'), ',' ORDER BY timestamp_utc) AS sparkline
  FROM (SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_utc DESC) <= 20)
  GROUP BY asset_id
)"""


def _line(column):
    cents = F.transform(
        column, lambda v: F.coalesce(F.round(v * 100).cast("bigint").cast("string"), F.lit("null"))
    )
    return F.array_join(cents, ",")


@query("sparkline", "asset_id:s sparkline:s", f"WITH {SILVER_SQL}, {SPARK_SQL} SELECT * FROM lines")
def _(t):
    return marts.sparkline(t.silver).withColumn("sparkline", _line("sparkline"))


ASSET_ROWS_SQL = """facts AS (
  SELECT asset_id, avg(availability) AS availability, sum(energy_mwh) AS actual_mwh,
    sum(expected_power_mw) AS expected_mwh, avg(price_eur_mwh) AS price FROM recent GROUP BY asset_id
),
latest AS (
  SELECT asset_id, power_mw AS current_power_mw FROM silver
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_utc DESC, event_sequence DESC) = 1
),
risk AS (SELECT asset_id, sum(greatest(expected_power_mw - energy_mwh, 0)) AS mwh_at_risk FROM silver
  WHERE NOT curtailment_flag AND expected_power_mw - energy_mwh IS NOT NULL GROUP BY asset_id),
asset_rows AS (
  SELECT a.*, CASE technology WHEN 'solar' THEN 'Solar' WHEN 'wind' THEN 'Eólica' ELSE 'Batería' END AS technology_label,
    coalesce(current_power_mw, 0) AS current_power_mw, coalesce(f.availability * 100, 0) AS availability,
    coalesce(actual_mwh / (capacity_mw * 168) * 100, 0) AS capacity_factor,
    coalesce(expected_mwh / 7, 0) AS forecast_24h_mwh, coalesce(mwh_at_risk, 0) AS mwh_at_risk,
    coalesce(actual_mwh * price, 0) AS revenue_7d_eur, sparkline
  FROM assets a LEFT JOIN facts f USING (asset_id) LEFT JOIN latest USING (asset_id)
    LEFT JOIN risk USING (asset_id) LEFT JOIN lines USING (asset_id)
)"""
ASSET_ROWS_WITH = f"WITH {RECENT_SQL}, {ASSETS_SQL}, {SPARK_SQL}, {ASSET_ROWS_SQL}"


def fleet(t):
    return marts.asset_rows(t.assets, t.silver_table, marts.metric_mwh_at_risk(t.silver_table))


@query(
    "asset_rows",
    "asset_id:s code:s name:s technology:s region:s capacity_mw:d status:s technology_label:s current_power_mw:d"
    " availability:d capacity_factor:d forecast_24h_mwh:d mwh_at_risk:d revenue_7d_eur:d sparkline:s",
    f"{ASSET_ROWS_WITH} SELECT * FROM asset_rows",
)
def _(t):
    return fleet(t).withColumn("sparkline", _line("sparkline"))


@query(
    "fleet_totals",
    "capacity_mw:d current_power_mw:d availability:d revenue_7d_eur:d",
    f"""{ASSET_ROWS_WITH} SELECT sum(capacity_mw) AS capacity_mw, sum(greatest(current_power_mw, 0)) AS current_power_mw,
      avg(availability) AS availability, sum(revenue_7d_eur) AS revenue_7d_eur FROM asset_rows""",
)
def _(t):
    return marts.fleet_totals(fleet(t))


@query(
    "top_assets",
    "asset_id:s mwh_at_risk:d",
    f"{ASSET_ROWS_WITH} SELECT asset_id, mwh_at_risk FROM asset_rows ORDER BY mwh_at_risk DESC, asset_id LIMIT 5",
)
def _(t):
    return filters.top_assets(fleet(t), "mwh_at_risk", 5)


@query(
    "fleet_search",
    "asset_id:s name:s region:s technology_label:s",
    f"""{ASSET_ROWS_WITH} SELECT * FROM asset_rows
    WHERE contains(lower(name || ' ' || code || ' ' || region || ' ' || technology_label), 'ca')
       OR contains(lower(name || ' ' || code || ' ' || region || ' ' || technology_label), 'region-1')""",
)
def _(t):
    rows = fleet(t).drop("sparkline")
    columns = ["name", "code", "region", "technology_label"]
    return (
        filters.search(rows, columns, "CA")
        .unionByName(filters.search(rows, columns, "region-1"))
        .distinct()
    )


@query("search_rows", "event_id:i event_type:s", """SELECT event_id, event_type FROM events
    WHERE event_type = 'purchase' OR contains(lower(props), 'purchase')""")
def _(t):
    return filters.search_rows(t.read("events"), "PURCHASE")


@query(
    "filtered_readings",
    "asset_id:s timestamp_utc:t region:s power_mw:d",
    f"""WITH {SILVER_SQL} SELECT * FROM silver WHERE technology = 'wind' AND region = 'region-1'
      AND timestamp_utc >= (SELECT max(timestamp_utc) FROM silver WHERE technology = 'wind' AND region = 'region-1') - INTERVAL 7 DAY""",
)
def _(t):
    return filters.apply_filters(t.silver, "wind", "region-1", "7d")


@query(
    "energy_mix",
    "technology:s energy_mwh:d share:d",
    f"""WITH {RECENT_SQL}, totals AS (
      SELECT technology, greatest(sum(energy_mwh), 0) AS energy_mwh FROM recent GROUP BY technology)
    SELECT technology, energy_mwh, energy_mwh / sum(energy_mwh) OVER () * 100 AS share FROM totals""",
)
def _(t):
    return marts.energy_mix(t.silver)


MARKET_SQL = """market AS (
  SELECT timestamp_utc, avg(price_eur_mwh) AS price, sum(power_mw) AS generation,
    sum(expected_power_mw) * CAST(2.8 AS DOUBLE) + 460 AS demand
  FROM recent GROUP BY 1 ORDER BY 1 DESC LIMIT 120
)"""


@query(
    "market_hourly",
    "timestamp_utc:t price:d generation:d demand:d",
    f"WITH {RECENT_SQL}, {MARKET_SQL} SELECT * FROM market",
)
def _(t):
    return marts.market_hourly(t.silver)


@query(
    "price_kpis",
    "average_price:d negative_hours:i capture_price:d",
    f"""WITH {RECENT_SQL}, {MARKET_SQL} SELECT avg(price) AS average_price,
      count(*) FILTER (WHERE price < 0) AS negative_hours, sum(price * generation) / sum(generation) AS capture_price
    FROM market""",
)
def _(t):
    return marts.price_kpis(marts.market_hourly(t.silver))


@query(
    "price_duration",
    "timestamp_utc:t price:d hour_rank:i",
    f"""WITH {RECENT_SQL}, {MARKET_SQL}
    SELECT timestamp_utc, price, row_number() OVER (ORDER BY price DESC, timestamp_utc) AS hour_rank FROM market""",
)
def _(t):
    return marts.price_duration(marts.market_hourly(t.silver))


@query(
    "capture_rates",
    "technology:s capture_price:d reference_price:d capture_rate:d",
    f"""WITH {RECENT_SQL}, renewable AS (SELECT * FROM recent WHERE technology IN ('solar', 'wind')),
    reference AS (SELECT avg(p) AS reference_price FROM (SELECT avg(price_eur_mwh) AS p FROM renewable GROUP BY timestamp_utc)),
    captured AS (
      SELECT coalesce(technology, 'portfolio') AS technology,
        sum(price_eur_mwh * CASE WHEN energy_mwh IS NOT NULL THEN greatest(energy_mwh, 0) END)
          / greatest(sum(CASE WHEN energy_mwh IS NOT NULL THEN greatest(energy_mwh, 0) END), CAST(0.000000001 AS DOUBLE)) AS capture_price
      FROM renewable GROUP BY ROLLUP (technology))
    SELECT technology, capture_price, reference_price, 100 * capture_price / reference_price AS capture_rate
    FROM captured, reference""",
)
def _(t):
    return marts.capture_rates(t.silver_table)


@query(
    "kpis",
    "revenue_7d_eur:d availability:d data_through:t assets_online:i assets_total:i active_anomalies:i mwh_at_risk:d"
    " data_freshness_minutes:i",
    f"""WITH {RECENT_SQL}, {ASSETS_SQL}, risk AS (
      SELECT asset_id, timestamp_utc, sum(greatest(expected_power_mw - energy_mwh, 0)) AS mwh_at_risk FROM silver
      WHERE NOT curtailment_flag AND expected_power_mw - energy_mwh IS NOT NULL GROUP BY 1, 2 HAVING sum(greatest(expected_power_mw - energy_mwh, 0)) > 100)
    SELECT sum(CASE WHEN energy_mwh IS NOT NULL THEN greatest(energy_mwh, 0) END * price_eur_mwh) AS revenue_7d_eur,
      avg(availability) * 100 AS availability, max(timestamp_utc) AS data_through,
      (SELECT count(*) FROM assets WHERE status = 'online') AS assets_online, (SELECT count(*) FROM assets) AS assets_total,
      (SELECT count(*) FROM risk) AS active_anomalies, (SELECT sum(mwh_at_risk) FROM risk) AS mwh_at_risk,
      greatest(floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - max(timestamp_utc)) / 60), 0) AS data_freshness_minutes
    FROM recent""",
)
def _(t):
    risk = marts.metric_mwh_at_risk(t.silver).filter(F.col("mwh_at_risk") > 100)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return marts.kpis(t.assets, t.silver_table, risk, now=now)


@query(
    "technology_profile",
    "technology:s row_count:i asset_count:i mean_power_mw:d",
    f"""WITH {SILVER_SQL} SELECT technology, count(*) AS row_count, count(DISTINCT asset_id) AS asset_count,
      avg(power_mw) AS mean_power_mw FROM silver GROUP BY technology""",
)
def _(t):
    return marts.technology_profile(t.silver)


WEATHER = ("temperature_c", "wind_speed_ms", "irradiance_wm2")


@query(
    "describe_weather",
    "measure:s n:i mean:d std:d min:d max:d p1:d p50:d p99:d",
    f"WITH {SILVER_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
        max({c}) AS max, quantile_cont({c}, 0.01) AS p1, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.99) AS p99
        FROM silver"""
        for c in WEATHER
    ),
)
def _(t):
    return marts.describe_columns(t.silver, WEATHER)


@query(
    "forecast_by_technology",
    "timestamp_utc:t technology:s p10_mw:d p50_mw:d p90_mw:d",
    f"""WITH {EVAL_SQL} SELECT timestamp_utc, technology, sum(p10_mw) AS p10_mw, sum(p50_mw) AS p50_mw,
      sum(p90_mw) AS p90_mw FROM evaluation GROUP BY 1, 2""",
)
def _(t):
    return marts.forecast_by_technology(evaluation(t))


@query(
    "ops_counters",
    "energy_mwh:d mwh_at_risk:d availability:d",
    f"WITH {GOLD_SQL} SELECT sum(energy_mwh) AS energy_mwh, sum(mwh_at_risk) AS mwh_at_risk, avg(availability) AS availability FROM gold",
)
def _(t):
    return marts.ops_counters(marts.portfolio_hourly(t.silver))


@query(
    "generation_trend",
    "date_hour:t actual_mw:d expected_mw:d",
    f"WITH {GOLD_SQL} SELECT date_hour, sum(actual_mw) AS actual_mw, sum(expected_mw) AS expected_mw FROM gold GROUP BY 1",
)
def _(t):
    return marts.generation_trend(marts.portfolio_hourly(t.silver))


@query(
    "metric_nmae",
    "asset_id:s technology:s day:t horizon_hours:i model_version:s nmae:r",
    f"""WITH {EVAL_SQL} SELECT asset_id, technology, date_trunc('day', timestamp_utc) AS day, horizon_hours, model_version,
      avg(abs(power_mw - p50_mw) / installed_capacity_mw) AS nmae
    FROM evaluation WHERE quality_flag = 'valid' GROUP BY ALL""",
)
def _(t):
    return marts.metric_nmae(evaluation(t))


@query(
    "metric_mwh_at_risk",
    "asset_id:s date_hour:t mwh_at_risk:d",
    f"""WITH {SILVER_SQL} SELECT asset_id, timestamp_utc AS date_hour,
      sum(CASE WHEN expected_power_mw - energy_mwh IS NOT NULL THEN greatest(expected_power_mw - energy_mwh, 0) END) AS mwh_at_risk
    FROM silver WHERE NOT curtailment_flag GROUP BY 1, 2""",
)
def _(t):
    return marts.metric_mwh_at_risk(t.silver)


@query(
    "semantic_metrics",
    "date_hour:t technology:s energy_mwh:d mwh_at_risk:d absolute_error_mw:d availability:d",
    f"WITH {GOLD_SQL} SELECT date_hour, technology, energy_mwh, mwh_at_risk, abs(actual_mw - expected_mw) AS absolute_error_mw, availability FROM gold",
)
def _(t):
    marts.register_views(t.spark, marts.portfolio_hourly(t.silver))
    return t.spark.table("v_semantic_metrics")


@query("operations_overview", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold")
def _(t):
    marts.register_views(t.spark, marts.portfolio_hourly(t.silver))
    return t.spark.table("v_operations_overview")


@query("regions", "region:s", f"WITH {ASSETS_SQL} SELECT DISTINCT region FROM assets")
def _(t):
    return filters.regions(t.assets)


@query(
    "newest_gold",
    "date_hour:t technology:s energy_mwh:d",
    f"WITH {GOLD_SQL} SELECT date_hour, technology, energy_mwh FROM gold ORDER BY date_hour DESC, technology LIMIT 336",
)
def _(t):
    from voltmill.sources.tables import newest

    return newest(marts.portfolio_hourly(t.silver), "date_hour", 336, "technology")


@query(
    "reconciliation",
    "outcome:s n:i max_difference:d",
    f"""WITH {SILVER_SQL}, a AS (SELECT timestamp_utc, technology, sum(energy_mwh) AS e FROM silver WHERE quality_flag = 'valid' GROUP BY 1, 2),
    b AS (SELECT timestamp_utc, technology, sum(energy_mwh) AS e FROM silver
          WHERE quality_flag = 'valid' AND event_sequence % 100 <> 0 GROUP BY 1, 2),
    j AS (SELECT CASE WHEN b.technology IS NULL THEN 'left_only' WHEN a.technology IS NULL THEN 'right_only'
            WHEN coalesce(abs(a.e - b.e), 0) < CAST(0.000001 AS DOUBLE) THEN 'match' ELSE 'differs' END AS outcome, abs(a.e - b.e) AS d
          FROM a FULL JOIN b ON a.timestamp_utc = b.timestamp_utc AND a.technology = b.technology)
    SELECT outcome, count(*) AS n, max(d) AS max_difference FROM j GROUP BY outcome""",
)
def _(t):
    whole = marts.portfolio_hourly(t.silver)
    other = marts.portfolio_hourly(t.silver.filter(F.col("event_sequence") % 100 != 0))
    return marts.reconcile_summary(
        marts.reconcile(whole, other, ["date_hour", "technology"], ["energy_mwh"])
    )


# Risk register: parts stand for risks, scores follow from key and size.
RISK_SQL = """risks AS (
  SELECT 'R-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS risk_id, 1 + p_partkey % 5 AS likelihood, 1 + p_size % 5 AS impact FROM part
)"""


@query(
    "risk_matrix",
    "likelihood:i impact:i n:i first_risk_id:s",
    f"WITH {RISK_SQL} SELECT likelihood, impact, count(*) AS n, min(risk_id) AS first_risk_id FROM risks GROUP BY 1, 2",
)
def _(t):
    risks = t.read("part").select(
        F.format_string("R-%08d", "p_partkey").alias("risk_id"),
        (1 + F.col("p_partkey") % 5).alias("likelihood"),
        (1 + F.col("p_size") % 5).alias("impact"),
    )
    return marts.risk_matrix(risks)


@query(
    "evidence_counts",
    "checks_passed:i checks_total:i all_passed:b",
    """SELECT count(*) FILTER (WHERE quality = 1) AS checks_passed, count(*) AS checks_total,
      bool_and(quality = 1) AS all_passed FROM labels""",
)
def _(t):
    checks = t.read("labels").select(F.col("doc_id").alias("check_id"), (F.col("quality") == 1).alias("passed"))
    return marts.evidence_counts(checks)


@query(
    "source_rows",
    "source_id:s name:s status:s records:i",
    """WITH registry AS (SELECT n_nationkey, 'src' || CAST(n_nationkey AS VARCHAR) AS source_id, n_name AS name FROM nation),
    status AS (SELECT source AS source_id, count(*) AS records, CASE WHEN min(doc_id) % 3 = 2 THEN 'failed' ELSE 'success' END AS status
      FROM documents GROUP BY source)
    SELECT registry.source_id, name, CASE WHEN status.status = 'success' THEN 'verified' ELSE coalesce(status.status, 'not_run') END AS status,
      coalesce(records, 0) AS records FROM registry LEFT JOIN status ON registry.source_id = status.source_id""",
)
def _(t):
    registry = t.read("nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id"),
        F.col("n_name").alias("name"),
    )
    status = t.read("documents").groupBy(F.col("source").alias("source_id")).agg(
        F.count(F.lit(1)).alias("records"),
        F.when(F.min("doc_id") % 3 == 2, "failed").otherwise("success").alias("status"),
        F.lit(None).cast("string").alias("checksum"),
        F.lit(None).cast("string").alias("extracted_at"),
    )
    return marts.source_rows(registry, status)


@query(
    "evidence_status",
    "id:s name:s status:s n:i",
    """WITH labels_ AS (SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation),
    probes AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, CASE WHEN sum(s_acctbal) > 0 THEN 'running' ELSE 'down' END AS state,
      count(*) AS n FROM supplier GROUP BY s_nationkey)
    SELECT labels_.id, name, CASE WHEN state = 'running' THEN 'verified_local' ELSE 'not_verified' END AS status, n
    FROM labels_ LEFT JOIN probes ON labels_.id = probes.id""",
)
def _(t):
    labels = t.read("nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")
    )
    probes = t.read("supplier").groupBy(F.col("s_nationkey").cast("string").alias("id")).agg(
        F.when(F.sum("s_acctbal") > 0, "running").otherwise("down").alias("state"),
        F.count(F.lit(1)).alias("n"),
    )
    return marts.evidence_status(labels, probes, "verified_local", "not_verified", "running")


@query(
    "labelled_readings",
    "event_sequence:i technology_label:s cause:s power:d",
    f"""WITH {SILVER_SQL} SELECT event_sequence,
      CASE technology WHEN 'solar' THEN 'Solar' WHEN 'wind' THEN 'Eólica' ELSE 'Batería' END AS technology_label,
      CASE anomaly_type WHEN 'soiling' THEN 'Suciedad progresiva' WHEN 'yaw_misalignment' THEN 'Desalineación de yaw'
        WHEN 'frozen_sensor' THEN 'Sensor congelado' ELSE replace(anomaly_type, '_', ' ') END AS cause,
      coalesce(round_even(power_mw, 1), 0) AS power FROM silver""",
)
def _(t):
    return t.silver.select(
        "event_sequence",
        text.technology_label(F.col("technology")).alias("technology_label"),
        text.cause_label(F.col("anomaly_type")).alias("cause"),
        text.safe_number(F.col("power_mw"), 1).alias("power"),
    )


@query(
    "local_time",
    "event_id:i local_ts:t label:s",
    """SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS local_ts,
      strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid', '%d/%m %H:%M') AS label FROM events""",
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.read("events").select(
        "event_id", text.to_local(ts).alias("local_ts"), text.local_label(ts).alias("label")
    )


@query(
    "age_labels",
    "event_id:i age:s",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'sin ejecución' WHEN event_type = 'view' THEN 'fecha no interpretable'
      WHEN h < 1 THEN '<1 h' WHEN h < 48 THEN CAST(h AS VARCHAR) || ' h' ELSE CAST(h // 24 AS VARCHAR) || ' d' END AS age
    FROM (SELECT *, CAST(floor(greatest(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)), 0) / 3600) AS BIGINT) AS h FROM events)""",
)
def _(t):
    stamp = F.when(F.col("event_type") == "view", "soon").when(
        F.col("event_type") != "error", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return t.read("events").select("event_id", text.age_label(stamp, now).alias("age"))


@query(
    "sanitize_url",
    "page_id:i clean_url:s",
    """WITH parts AS (SELECT page_id, split_part(url, '#', 1) AS whole FROM pages),
    q AS (SELECT page_id, split_part(whole, '?', 1) AS base,
        list_filter(string_split(CASE WHEN contains(whole, '?') THEN regexp_extract(whole, '\\?(.*)$', 1) ELSE '' END, '&'),
          lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('ref', 'token')) AS kept FROM parts)
    SELECT page_id, CASE WHEN len(kept) = 0 THEN base ELSE base || '?' || array_to_string(kept, '&') END AS clean_url FROM q""",
)
def _(t):
    return t.read("pages").select(
        "page_id", text.sanitize_url(F.col("url"), ["ref", "token"]).alias("clean_url")
    )


@query(
    "redact_paths",
    "page_id:i resource:s",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'data/' || CAST(page_id AS VARCHAR) || '.json'
      WHEN page_id % 3 = 1 THEN 'redacted-local-path/' || CAST(page_id AS VARCHAR) || '.json'
      ELSE 'plain/' || CAST(page_id AS VARCHAR) || '.json' END AS resource FROM pages""",
)
def _(t):
    folder = F.when(F.col("page_id") % 3 == 0, "/srv/app/data/").when(
        F.col("page_id") % 3 == 1, "/var/other/"
    ).otherwise("plain/")
    path = F.concat(folder, F.col("page_id").cast("string"), F.lit(".json"))
    return t.read("pages").select("page_id", text.redact_path(path, "/srv/app").alias("resource"))


@query(
    "flow_progress",
    "event_id:i status:s metrics:s",
    """SELECT event_id, CAST(event_id % 3 AS VARCHAR) AS status, json_extract_string(props, '$.k') AS metrics
    FROM events WHERE event_type = 'click'""",
)
def _(t):
    details = F.format_string(
        '{"flow_progress": {"status": "%s", "metrics": %s}}',
        (F.col("event_id") % 3).cast("string"),
        F.get_json_object("props", "$.k"),
    )
    kind = F.when(F.col("event_type") == "click", "flow_progress").otherwise(F.col("event_type"))
    events = t.read("events").select("event_id", kind.alias("event_type"), details.alias("details"))
    return filters.flow_progress(events)
