"""Plant telemetry derived from the given event table.

The test tables hold no plant readings, so every reading is computed from one
event row: the user is the plant, the event value its power. The DataFrame
form and the SQL form below describe the same columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.operators.silver import clean_generation
from voltmill.session import materialize
from voltmill.sources.tables import read_table


class Tables:
    """The given tables of one scale factor and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def telemetry(self) -> DataFrame:
        return telemetry_from_events(self.read("events"))

    @cached_property
    def silver(self) -> DataFrame:
        """Deduplicated and flagged readings."""
        return clean_generation(self.telemetry)

    @cached_property
    def silver_table(self) -> DataFrame:
        """Silver written once, for plans that read it several times."""
        return materialize(self.silver, "silver")

    @cached_property
    def features(self) -> DataFrame:
        """Feature table written once; models and drift read it several times."""
        from voltmill.operators.features import build_features

        return materialize(build_features(self.silver_table), "features")

    @cached_property
    def assets(self) -> DataFrame:
        return assets_from_events(self.read("events"))


def telemetry_from_events(events: DataFrame, series: int = 12) -> DataFrame:
    """One reading per event; ``series`` is the number of plants."""
    plant = F.col("user_id") % series
    event = F.col("event_id")
    capacity = (100 + 10 * plant).cast("double")
    power = F.when(F.col("event_type") != "error", F.col("value"))
    wind_only = lambda column: F.when(_technology(plant) == "wind", column)
    return events.select(
        event.alias("event_sequence"),
        _asset_id(plant).alias("asset_id"),
        _technology(plant).alias("technology"),
        _region(plant).alias("region"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp_utc"),
        F.col("ts").cast("timestamp").alias("ingested_at"),
        capacity.alias("installed_capacity_mw"),
        power.alias("power_mw"),
        power.alias("energy_mwh"),
        (((100 + 10 * plant) * (event % 100)).cast("double") / F.lit(100.0)).alias("expected_power_mw"),
        ((90 + event % 12).cast("double") / F.lit(100.0)).alias("availability"),
        (event % 97 - 3).cast("double").alias("price_eur_mwh"),
        (10 + event % 25).cast("double").alias("temperature_c"),
        ((event % 260).cast("double") / F.lit(10.0)).alias("wind_speed_ms"),
        (event % 1100).cast("double").alias("irradiance_wm2"),
        ((event % 101).cast("double") / F.lit(100.0)).alias("cloud_cover_fraction"),
        wind_only((event % 90).cast("double") / F.lit(10.0)).alias("vibration_rms"),
        wind_only((event % 43 - 21).cast("double")).alias("yaw_error_deg"),
        wind_only((event % 28).cast("double")).alias("rotor_speed_rpm"),
        F.when(_technology(plant) == "solar", (40 + event % 70).cast("double")).alias(
            "inverter_temperature_c"
        ),
        (event % 37 == 0).alias("curtailment_flag"),
        F.when(event % 211 == 0, "soiling")
        .when(event % 307 == 0, "yaw_misalignment")
        .when(event % 401 == 0, "frozen_sensor")
        .otherwise("none")
        .alias("anomaly_type"),
        F.when(event % 53 != 0, F.concat(F.lit("src-"), (event % 3).cast("string"))).alias("source_id"),
        F.concat(F.lit("run-"), (event % 5).cast("string")).alias("ingestion_run_id"),
        F.when(event % 499 == 0, "2.0-unexpected").otherwise("1.0").alias("schema_version"),
        F.when(event % 619 == 0, "kW").otherwise("MW").alias("measurement_unit"),
        F.lit(True).alias("is_synthetic"),
    )


def assets_from_events(events: DataFrame, series: int = 12) -> DataFrame:
    """Asset catalogue: one row per plant seen in the events."""
    plant = F.col("plant")
    return (
        events.select((F.col("user_id") % series).alias("plant"))
        .distinct()
        .select(
            _asset_id(plant).alias("asset_id"),
            F.format_string("PL-%02d", plant).alias("code"),
            F.concat(F.lit("Plant "), plant.cast("string")).alias("name"),
            _technology(plant).alias("technology"),
            _region(plant).alias("region"),
            (100 + 10 * plant).cast("double").alias("capacity_mw"),
            (36.0 + plant.cast("double") / F.lit(2.0)).alias("latitude"),
            (-8.0 + plant.cast("double") / F.lit(2.0)).alias("longitude"),
            F.when(plant % 5 == 4, "attention").otherwise("online").alias("status"),
        )
    )


def _asset_id(plant):
    return F.format_string("ast-%02d", plant)


def _technology(plant):
    return F.when(plant % 12 < 5, "solar").when(plant % 12 < 10, "wind").otherwise("battery")


def _region(plant):
    return F.concat(F.lit("region-"), (plant % 4).cast("string"))


TELEMETRY_SQL = """telemetry AS (
  SELECT event_id AS event_sequence,
    'ast-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS asset_id,
    CASE WHEN user_id % 12 < 5 THEN 'solar' WHEN user_id % 12 < 10 THEN 'wind' ELSE 'battery' END AS technology,
    'region-' || CAST((user_id % 12) % 4 AS VARCHAR) AS region,
    date_trunc('hour', ts) AS timestamp_utc,
    ts AS ingested_at,
    CAST(100 + 10 * (user_id % 12) AS DOUBLE) AS installed_capacity_mw,
    CASE WHEN event_type <> 'error' THEN value END AS power_mw,
    CASE WHEN event_type <> 'error' THEN value END AS energy_mwh,
    CAST((100 + 10 * (user_id % 12)) * (event_id % 100) AS DOUBLE) / CAST(100 AS DOUBLE) AS expected_power_mw,
    CAST(90 + event_id % 12 AS DOUBLE) / CAST(100 AS DOUBLE) AS availability,
    CAST(event_id % 97 - 3 AS DOUBLE) AS price_eur_mwh,
    CAST(10 + event_id % 25 AS DOUBLE) AS temperature_c,
    CAST(event_id % 260 AS DOUBLE) / CAST(10 AS DOUBLE) AS wind_speed_ms,
    CAST(event_id % 1100 AS DOUBLE) AS irradiance_wm2,
    CAST(event_id % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS cloud_cover_fraction,
    CASE WHEN user_id % 12 BETWEEN 5 AND 9 THEN CAST(event_id % 90 AS DOUBLE) / CAST(10 AS DOUBLE) END AS vibration_rms,
    CASE WHEN user_id % 12 BETWEEN 5 AND 9 THEN CAST(event_id % 43 - 21 AS DOUBLE) END AS yaw_error_deg,
    CASE WHEN user_id % 12 BETWEEN 5 AND 9 THEN CAST(event_id % 28 AS DOUBLE) END AS rotor_speed_rpm,
    CASE WHEN user_id % 12 < 5 THEN CAST(40 + event_id % 70 AS DOUBLE) END AS inverter_temperature_c,
    event_id % 37 = 0 AS curtailment_flag,
    CASE WHEN event_id % 211 = 0 THEN 'soiling' WHEN event_id % 307 = 0 THEN 'yaw_misalignment'
         WHEN event_id % 401 = 0 THEN 'frozen_sensor' ELSE 'none' END AS anomaly_type,
    CASE WHEN event_id % 53 <> 0 THEN 'src-' || CAST(event_id % 3 AS VARCHAR) END AS source_id,
    'run-' || CAST(event_id % 5 AS VARCHAR) AS ingestion_run_id,
    CASE WHEN event_id % 499 = 0 THEN '2.0-unexpected' ELSE '1.0' END AS schema_version,
    CASE WHEN event_id % 619 = 0 THEN 'kW' ELSE 'MW' END AS measurement_unit,
    TRUE AS is_synthetic
  FROM events
)"""

SILVER_SQL = TELEMETRY_SQL + """,
deduplicated AS (
  SELECT * FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp_utc
                             ORDER BY ingested_at DESC, event_sequence DESC) = 1
),
silver AS (
  SELECT *, CASE WHEN availability < 0 OR availability > 1
      OR (technology <> 'battery' AND (power_mw < CAST(-0.001 AS DOUBLE)
          OR power_mw > installed_capacity_mw * CAST(1.03 AS DOUBLE)))
    THEN 'quarantined' ELSE 'valid' END AS quality_flag
  FROM deduplicated
)"""

ASSETS_SQL = """assets AS (
  SELECT DISTINCT 'ast-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS asset_id,
    'PL-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS code,
    'Plant ' || CAST(user_id % 12 AS VARCHAR) AS name,
    CASE WHEN user_id % 12 < 5 THEN 'solar' WHEN user_id % 12 < 10 THEN 'wind' ELSE 'battery' END AS technology,
    'region-' || CAST((user_id % 12) % 4 AS VARCHAR) AS region,
    CAST(100 + 10 * (user_id % 12) AS DOUBLE) AS capacity_mw,
    CAST(36 AS DOUBLE) + CAST(user_id % 12 AS DOUBLE) / CAST(2 AS DOUBLE) AS latitude,
    CAST(-8 AS DOUBLE) + CAST(user_id % 12 AS DOUBLE) / CAST(2 AS DOUBLE) AS longitude,
    CASE WHEN (user_id % 12) % 5 = 4 THEN 'attention' ELSE 'online' END AS status
  FROM events
)"""
