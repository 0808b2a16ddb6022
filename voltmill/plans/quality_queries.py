"""Silver, contract and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.operators import governance, quality, silver
from voltmill.plans.registry import query
from voltmill.plans.telemetry import SILVER_SQL, TELEMETRY_SQL
from voltmill.session import new_path


@query(
    "silver_dedup",
    "asset_id:s timestamp_utc:t event_sequence:i ingested_at:t power_mw:d availability:d",
    f"WITH {SILVER_SQL} SELECT * FROM deduplicated",
)
def _(t):
    return silver.dedup_latest(silver.normalize_utc(t.telemetry))


@query(
    "silver_flag",
    "asset_id:s timestamp_utc:t technology:s power_mw:d availability:d quality_flag:s",
    f"WITH {SILVER_SQL} SELECT * FROM silver",
)
def _(t):
    return t.silver


def gap_sql(column: str, limit: int = 3, ffill: int = 1) -> str:
    """Short-gap repair of one column over the frame ``numbered``."""
    before_p = f"max(CASE WHEN {column} IS NOT NULL THEN pos END) OVER up"
    after_p = f"min(CASE WHEN {column} IS NOT NULL THEN pos END) OVER down"
    before_v = f"last_value({column} IGNORE NULLS) OVER up"
    after_v = f"first_value({column} IGNORE NULLS) OVER down"
    step = f"(pos - {before_p})"
    return f"""CASE WHEN {column} IS NOT NULL THEN {column}
      WHEN {step} <= {limit + ffill} THEN coalesce(
        {before_v} + ({after_v} - {before_v}) * least({step}, {limit}) / ({after_p} - {before_p}),
        {before_v}) END AS {column}"""


FILLED_SQL = (
    SILVER_SQL
    + f""",
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_utc) AS pos FROM silver
),
filled AS (
  SELECT * REPLACE ({', '.join(gap_sql(c) for c in ('power_mw', 'expected_power_mw', 'availability',
                                                    'irradiance_wm2', 'temperature_c',
                                                    'cloud_cover_fraction', 'wind_speed_ms',
                                                    'price_eur_mwh'))})
  FROM numbered
  WINDOW up AS (PARTITION BY asset_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY asset_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""
)


@query(
    "silver_gapfill",
    "asset_id:s timestamp_utc:t quality_flag:s power_mw:d expected_power_mw:d availability:d"
    " irradiance_wm2:d temperature_c:d wind_speed_ms:d price_eur_mwh:d",
    f"WITH {FILLED_SQL} SELECT * FROM filled",
)
def _(t):
    # five-day buckets, so that readings are carried over several edges
    return silver.fill_short_gaps(t.silver, bucket_seconds=5 * 86_400)


@query(
    "quarantine_reasons",
    "event_sequence:i asset_id:s reasons:s",
    f"""WITH {TELEMETRY_SQL}, checked AS (
      SELECT *, concat_ws(',',
        CASE WHEN NOT (availability BETWEEN 0 AND 1) THEN 'availability_range' END,
        CASE WHEN NOT (technology = 'battery' OR (power_mw >= CAST(-0.001 AS DOUBLE)
             AND power_mw <= installed_capacity_mw * CAST(1.03 AS DOUBLE))) THEN 'physical_power_range' END) AS reasons
      FROM telemetry)
    SELECT * FROM checked WHERE reasons <> ''""",
)
def _(t):
    return silver.quarantine(t.telemetry).withColumn("reasons", F.array_join("violations", ","))


@query(
    "silver_expectations",
    "rule:s violations:i row_count:i",
    f"""WITH {TELEMETRY_SQL}
    SELECT 'asset_id_present' AS rule, count(*) FILTER (WHERE asset_id IS NULL) AS violations, count(*) AS row_count FROM telemetry
    UNION ALL SELECT 'timestamp_present', count(*) FILTER (WHERE timestamp_utc IS NULL), count(*) FROM telemetry
    UNION ALL SELECT 'availability_range', count(*) FILTER (WHERE coalesce(availability BETWEEN 0 AND 1, FALSE) = FALSE), count(*) FROM telemetry
    UNION ALL SELECT 'known_technology', count(*) FILTER (WHERE coalesce(technology IN ('solar', 'wind', 'battery'), FALSE) = FALSE), count(*) FROM telemetry
    UNION ALL SELECT 'physical_power_range', count(*) FILTER (WHERE coalesce(technology = 'battery' OR (power_mw >= CAST(-0.001 AS DOUBLE)
        AND power_mw <= installed_capacity_mw * CAST(1.03 AS DOUBLE)), FALSE) = FALSE), count(*) FROM telemetry""",
)
def _(t):
    """Broken rules as the write of the table counts them, from the ledger of the run."""
    stage = governance.Stage("Bronze", lambda _: t.telemetry, {**silver.SILVER_RULES, **silver.POWER_RULE})
    ledger = new_path(t.spark, "ledger")
    governance.run_stages(t.spark, [stage], new_path(t.spark, "run"), ledger, "run-1")
    return governance.rule_counts(t.spark, ledger, "run-1")


@query(
    "expectations_drop",
    "event_sequence:i asset_id:s technology:s power_mw:d",
    f"""WITH {TELEMETRY_SQL} SELECT * FROM telemetry WHERE technology = 'battery'
      OR (power_mw >= CAST(-0.001 AS DOUBLE) AND power_mw <= installed_capacity_mw * CAST(1.03 AS DOUBLE))""",
)
def _(t):
    return silver.expect(t.telemetry, silver.POWER_RULE, "drop")[0]


@query(
    "contract_violations",
    "contract:s rule:s violations:i row_count:i",
    f"""WITH {SILVER_SQL}, n AS (SELECT count(*) AS row_count FROM silver),
    found AS (
      SELECT 'generation' AS contract, 'required:timestamp_utc' AS rule, count(*) FILTER (WHERE timestamp_utc IS NULL) AS violations FROM silver
      UNION ALL SELECT 'generation', 'required:asset_id', count(*) FILTER (WHERE asset_id IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:technology', count(*) FILTER (WHERE technology IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:power_mw', count(*) FILTER (WHERE power_mw IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:energy_mwh', count(*) FILTER (WHERE energy_mwh IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:availability', count(*) FILTER (WHERE availability IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:source_id', count(*) FILTER (WHERE source_id IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:quality_flag', count(*) FILTER (WHERE quality_flag IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'required:is_synthetic', count(*) FILTER (WHERE is_synthetic IS NULL) FROM silver
      UNION ALL SELECT 'generation', 'min_length:asset_id', count(*) FILTER (WHERE length(asset_id) < 3) FROM silver
      UNION ALL SELECT 'generation', 'enum:technology', count(*) FILTER (WHERE technology NOT IN ('solar', 'wind', 'battery')) FROM silver
      UNION ALL SELECT 'generation', 'enum:quality_flag', count(*) FILTER (WHERE quality_flag NOT IN ('valid', 'imputed', 'suspect', 'quarantined')) FROM silver
      UNION ALL SELECT 'generation', 'minimum:power_mw', count(*) FILTER (WHERE power_mw < CAST(-0.001 AS DOUBLE)) FROM silver
      UNION ALL SELECT 'generation', 'minimum:availability', count(*) FILTER (WHERE availability < 0) FROM silver
      UNION ALL SELECT 'generation', 'maximum:availability', count(*) FILTER (WHERE availability > 1) FROM silver
      UNION ALL SELECT 'weather', 'required:timestamp_utc', count(*) FILTER (WHERE timestamp_utc IS NULL) FROM silver
      UNION ALL SELECT 'weather', 'required:station_id', count(*) FILTER (WHERE asset_id IS NULL) FROM silver
      UNION ALL SELECT 'weather', 'required:temperature_c', count(*) FILTER (WHERE temperature_c IS NULL) FROM silver
      UNION ALL SELECT 'weather', 'required:wind_speed_ms', count(*) FILTER (WHERE wind_speed_ms IS NULL) FROM silver
      UNION ALL SELECT 'weather', 'required:source_id', count(*) FILTER (WHERE source_id IS NULL) FROM silver
      UNION ALL SELECT 'weather', 'min_length:station_id', count(*) FILTER (WHERE length(asset_id) < 1) FROM silver
      UNION ALL SELECT 'weather', 'minimum:temperature_c', count(*) FILTER (WHERE temperature_c < -60) FROM silver
      UNION ALL SELECT 'weather', 'minimum:wind_speed_ms', count(*) FILTER (WHERE wind_speed_ms < 0) FROM silver
      UNION ALL SELECT 'weather', 'minimum:irradiance_wm2', count(*) FILTER (WHERE irradiance_wm2 < 0) FROM silver
      UNION ALL SELECT 'weather', 'maximum:temperature_c', count(*) FILTER (WHERE temperature_c > 70) FROM silver
      UNION ALL SELECT 'weather', 'maximum:wind_speed_ms', count(*) FILTER (WHERE wind_speed_ms > 100) FROM silver
      UNION ALL SELECT 'weather', 'maximum:irradiance_wm2', count(*) FILTER (WHERE irradiance_wm2 > 1600) FROM silver
      UNION ALL SELECT 'weather', 'additional:price_eur_mwh', count(*) FROM silver
      UNION ALL SELECT 'price', 'required:timestamp_utc', count(*) FILTER (WHERE timestamp_utc IS NULL) FROM silver
      UNION ALL SELECT 'price', 'required:market', count(*) FROM silver
      UNION ALL SELECT 'price', 'required:price_eur_mwh', count(*) FILTER (WHERE price_eur_mwh IS NULL) FROM silver
      UNION ALL SELECT 'price', 'required:source_id', count(*) FILTER (WHERE source_id IS NULL) FROM silver
      UNION ALL SELECT 'price', 'minimum:price_eur_mwh', count(*) FILTER (WHERE price_eur_mwh < -1000) FROM silver
      UNION ALL SELECT 'price', 'maximum:price_eur_mwh', count(*) FILTER (WHERE price_eur_mwh > 10000) FROM silver)
    SELECT found.*, n.row_count FROM found CROSS JOIN n""",
)
def _(t):
    rows = t.silver
    weather = rows.select(
        "timestamp_utc",
        F.col("asset_id").alias("station_id"),
        "temperature_c",
        "wind_speed_ms",
        "irradiance_wm2",
        "source_id",
        "price_eur_mwh",
    )
    price = rows.select("timestamp_utc", "price_eur_mwh", "source_id")
    parts = [
        quality.validate_contract(frame, name).withColumn("contract", F.lit(name))
        for name, frame in (("generation", rows), ("weather", weather), ("price", price))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# A forecast-shaped table: P50 is the expected power, the band follows from
# availability; event ids that are multiples of 50 get crossed quantiles.
EVAL_SQL = (
    SILVER_SQL
    + """,
evaluation AS (
  SELECT timestamp_utc, asset_id, technology, quality_flag, power_mw, installed_capacity_mw,
    CASE WHEN event_sequence % 50 = 0 THEN expected_power_mw + 1 ELSE expected_power_mw * CAST(0.8 AS DOUBLE) END AS p10_mw,
    expected_power_mw AS p50_mw,
    expected_power_mw * CAST(1.2 AS DOUBLE) AS p90_mw,
    least(greatest(CAST(floor(epoch(timestamp_utc - TIMESTAMP '2024-01-01 00:00:00') / 3600) AS BIGINT), 1), 336) AS horizon_hours,
    'v' || CAST(event_sequence % 2 AS VARCHAR) AS model_version
  FROM silver WHERE technology IN ('solar', 'wind')
)"""
)


def evaluation(t):
    """Forecast-shaped frame derived from Silver (same rule as ``EVAL_SQL``)."""
    from voltmill.operators.forecast import horizon

    expected = F.col("expected_power_mw")
    rows = t.silver.filter(F.col("technology").isin("solar", "wind"))
    return horizon(rows, F.lit("2024-01-01 00:00:00").cast("timestamp")).select(
        "timestamp_utc",
        "asset_id",
        "technology",
        "quality_flag",
        "power_mw",
        "installed_capacity_mw",
        F.when(F.col("event_sequence") % 50 == 0, expected + 1).otherwise(expected * 0.8).alias("p10_mw"),
        expected.alias("p50_mw"),
        (expected * 1.2).alias("p90_mw"),
        "horizon_hours",
        F.concat(F.lit("v"), (F.col("event_sequence") % 2).cast("string")).alias("model_version"),
    )


@query(
    "prediction_contract",
    "rule:s violations:i row_count:i",
    f"""WITH {EVAL_SQL}
    SELECT rule, violations, (SELECT count(*) FROM evaluation) AS row_count FROM (
      SELECT 'required:timestamp_utc' AS rule, count(*) FILTER (WHERE timestamp_utc IS NULL) AS violations FROM evaluation
      UNION ALL SELECT 'required:asset_id', count(*) FILTER (WHERE asset_id IS NULL) FROM evaluation
      UNION ALL SELECT 'required:horizon_hours', count(*) FILTER (WHERE horizon_hours IS NULL) FROM evaluation
      UNION ALL SELECT 'required:p10_mw', count(*) FILTER (WHERE p10_mw IS NULL) FROM evaluation
      UNION ALL SELECT 'required:p50_mw', count(*) FILTER (WHERE p50_mw IS NULL) FROM evaluation
      UNION ALL SELECT 'required:p90_mw', count(*) FILTER (WHERE p90_mw IS NULL) FROM evaluation
      UNION ALL SELECT 'required:model_version', count(*) FILTER (WHERE model_version IS NULL) FROM evaluation
      UNION ALL SELECT 'min_length:asset_id', count(*) FILTER (WHERE length(asset_id) < 1) FROM evaluation
      UNION ALL SELECT 'minimum:horizon_hours', count(*) FILTER (WHERE horizon_hours < 1) FROM evaluation
      UNION ALL SELECT 'minimum:p10_mw', count(*) FILTER (WHERE p10_mw < 0) FROM evaluation
      UNION ALL SELECT 'minimum:p50_mw', count(*) FILTER (WHERE p50_mw < 0) FROM evaluation
      UNION ALL SELECT 'minimum:p90_mw', count(*) FILTER (WHERE p90_mw < 0) FROM evaluation
      UNION ALL SELECT 'maximum:horizon_hours', count(*) FILTER (WHERE horizon_hours > 168) FROM evaluation
      UNION ALL SELECT 'order:quantiles', count(*) FILTER (WHERE p10_mw > p50_mw OR p50_mw > p90_mw) FROM evaluation)""",
)
def _(t):
    columns = quality.CONTRACTS["prediction"]["columns"]
    frame = evaluation(t)
    return quality.validate_contract(frame.select(*[c for c in columns if c in frame.columns]), "prediction")


@query(
    "gold_checks",
    "check_id:s violations:i passed:b",
    f"""WITH {EVAL_SQL}
    SELECT 'duplicate_keys' AS check_id, count(*) AS violations, count(*) = 0 AS passed FROM (
      SELECT asset_id, timestamp_utc FROM evaluation GROUP BY ALL HAVING count(*) > 1)
    UNION ALL
    SELECT 'quantile_order', count(*), count(*) = 0 FROM evaluation
    WHERE p10_mw > p50_mw OR p50_mw > p90_mw OR p10_mw < 0""",
)
def _(t):
    return quality.gold_checks(evaluation(t))


@query(
    "duplicate_keys",
    "asset_id:s timestamp_utc:t duplicate_count:i",
    f"""WITH {TELEMETRY_SQL} SELECT asset_id, timestamp_utc, count(*) AS duplicate_count
    FROM telemetry GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    return quality.duplicate_keys(t.telemetry)


SCORECARD_SQL = """silver_card AS (
  SELECT 'SCADA Silver' AS dataset, least(CAST(100 AS DOUBLE), 100 * n / greatest(assets * hours, CAST(1 AS DOUBLE))) AS freshness,
    100 * (1 - CAST(missing AS DOUBLE) / (n * 6)) AS completeness,
    100 * (1 - CAST(quarantined AS DOUBLE) / n) AS validity,
    100 * (1 - CAST(n - keys AS DOUBLE) / n) AS uniqueness
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT (asset_id, timestamp_utc)) AS keys,
      sum(CAST(timestamp_utc IS NULL AS INT) + CAST(asset_id IS NULL AS INT) + CAST(power_mw IS NULL AS INT)
        + CAST(availability IS NULL AS INT) + CAST(source_id IS NULL AS INT) + CAST(quality_flag IS NULL AS INT)) AS missing,
      count(*) FILTER (WHERE quality_flag = 'quarantined') AS quarantined,
      count(DISTINCT asset_id) AS assets,
      epoch(max(timestamp_utc) - min(timestamp_utc)) / 3600 + 1 AS hours FROM silver)
),
gold_card AS (
  SELECT 'Forecast Gold' AS dataset, CAST(100 AS DOUBLE) AS freshness,
    100 * (1 - CAST(missing AS DOUBLE) / (n * 11)) AS completeness,
    100 * CAST(ordered AS DOUBLE) / n AS validity,
    100 * (1 - CAST(n - keys AS DOUBLE) / n) AS uniqueness, n, ordered
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT (asset_id, timestamp_utc)) AS keys,
      sum(CAST(timestamp_utc IS NULL AS INT) + CAST(asset_id IS NULL AS INT) + CAST(technology IS NULL AS INT)
        + CAST(quality_flag IS NULL AS INT) + CAST(power_mw IS NULL AS INT) + CAST(installed_capacity_mw IS NULL AS INT)
        + CAST(p10_mw IS NULL AS INT) + CAST(p50_mw IS NULL AS INT) + CAST(p90_mw IS NULL AS INT)
        + CAST(horizon_hours IS NULL AS INT) + CAST(model_version IS NULL AS INT)) AS missing,
      count(*) FILTER (WHERE p10_mw <= p50_mw AND p50_mw <= p90_mw) AS ordered FROM evaluation)
),
scorecard AS (
  SELECT dataset, freshness, completeness, validity, uniqueness,
    CASE WHEN least(freshness, completeness, validity, uniqueness) >= 99 THEN 'passed' ELSE 'watch' END AS status FROM silver_card
  UNION ALL
  SELECT dataset, freshness, completeness, validity, uniqueness,
    CASE WHEN ordered = n THEN 'passed' ELSE 'failed' END FROM gold_card
  UNION ALL
  SELECT name || ' Bronze', CAST(99 AS DOUBLE), CAST(CASE WHEN records > 0 THEN 100 ELSE 0 END AS DOUBLE),
    CAST(100 AS DOUBLE), CAST(100 AS DOUBLE), CASE WHEN records > 0 THEN 'passed' ELSE 'failed' END
  FROM (SELECT source AS name, count(*) AS records FROM documents GROUP BY source)
)"""


def document_sources(t):
    """Source states in the shape of the source table, one per document source."""
    return t.read("documents").groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("records"),
        F.lit("verified").alias("status"),
        F.lit("2024-01-01T00:00:00Z").alias("extracted_at"),
        F.lit("sha256").alias("checksum"),
    )


@query(
    "quality_scorecard",
    "dataset:s freshness:d completeness:d validity:d uniqueness:d status:s",
    f"WITH {EVAL_SQL}, {SCORECARD_SQL} SELECT * FROM scorecard",
)
def _(t):
    return quality.quality_scorecard(t.silver, evaluation(t), document_sources(t))


@query(
    "quality_summary",
    "checks_executed:i checks_passed:i checks_watch_or_failed:i overall_validity:d quarantined_rows:i quarantined_rate:d",
    f"""WITH {EVAL_SQL}, {SCORECARD_SQL}
    SELECT count(*) * 4 AS checks_executed, count(*) FILTER (WHERE status = 'passed') * 4 AS checks_passed,
      count(*) FILTER (WHERE status <> 'passed') * 4 AS checks_watch_or_failed, avg(validity) AS overall_validity,
      (SELECT count(*) FILTER (WHERE quality_flag = 'quarantined') FROM silver) AS quarantined_rows,
      (SELECT 100 * CAST(count(*) FILTER (WHERE quality_flag = 'quarantined') AS DOUBLE) / count(*) FROM silver) AS quarantined_rate
    FROM scorecard""",
)
def _(t):
    card = quality.quality_scorecard(t.silver, evaluation(t), document_sources(t))
    return quality.quality_summary(card, t.silver)


@query(
    "acceptance_report",
    "check_id:s passed:b",
    f"""WITH {EVAL_SQL}
    SELECT 'row_count' AS check_id, count(*) >= 5000 AS passed FROM silver
    UNION ALL SELECT 'asset_count', count(DISTINCT asset_id) = 12 FROM silver
    UNION ALL SELECT 'all_synthetic', bool_and(is_synthetic) FROM silver
    UNION ALL SELECT 'unique_key', count(*) = count(DISTINCT (asset_id, timestamp_utc)) FROM silver
    UNION ALL SELECT 'quantile_order', count(*) = 0 FROM evaluation WHERE p10_mw > p50_mw OR p50_mw > p90_mw OR p10_mw < 0
    UNION ALL SELECT 'dataset_ids', count(*) = 0 FROM (
      (SELECT DISTINCT source_id FROM silver WHERE source_id IS NOT NULL EXCEPT SELECT * FROM (VALUES ('src-0'), ('src-1'), ('src-2')))
      UNION ALL (SELECT * FROM (VALUES ('src-0'), ('src-1'), ('src-2')) EXCEPT SELECT DISTINCT source_id FROM silver))""",
)
def _(t):
    found = t.silver.filter(F.col("source_id").isNotNull()).select(F.col("source_id").alias("dataset_id"))
    return quality.acceptance_report(
        t.silver, evaluation(t), 12, 5000, found, ("src-0", "src-1", "src-2")
    )


@query(
    "flag_counts",
    "quality_flag:s n:i",
    f"WITH {SILVER_SQL} SELECT quality_flag, count(*) AS n FROM silver GROUP BY quality_flag",
)
def _(t):
    return quality.flag_counts(t.silver)


@query(
    "freshness",
    "latest_hour:t row_count:i",
    f"WITH {SILVER_SQL} SELECT max(timestamp_utc) AS latest_hour, count(*) AS row_count FROM silver",
)
def _(t):
    return quality.freshness(t.silver, "timestamp_utc")


@query(
    "json_shape",
    "shape_hash:s event_type:s n:i",
    """WITH typed AS (SELECT event_type, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN json_type(props, '$.k') = 'DOUBLE' THEN 'float'
      ELSE 'str' END AS kind FROM events)
    SELECT sha256('{"k":"' || kind || '"}') AS shape_hash, event_type, count(*) AS n FROM typed GROUP BY 1, 2""",
)
def _(t):
    return quality.shape_report(t.read("events"), "props", ["event_type"])
