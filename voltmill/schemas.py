"""Record types, vocabularies and contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the data model.
TECHNOLOGIES = ("solar", "wind", "battery")
RENEWABLE = ("solar", "wind")
QUALITY_FLAGS = ("valid", "imputed", "suspect", "quarantined")
GAP_COLUMNS = (
    "power_mw",
    "expected_power_mw",
    "availability",
    "irradiance_wm2",
    "temperature_c",
    "cloud_cover_fraction",
    "wind_speed_ms",
    "price_eur_mwh",
)
FEATURES = (
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
    "irradiance_wm2",
    "temperature_c",
    "cloud_cover_fraction",
    "wind_speed_ms",
    "availability",
    "lag_1h_mw",
    "lag_24h_mw",
    "lag_168h_mw",
    "rolling_24h_mw",
)
CALENDAR_FEATURES = ("hour_sin", "hour_cos", "day_sin", "day_cos")
LAG_FEATURES = ("lag_1h_mw", "lag_24h_mw", "lag_168h_mw", "rolling_24h_mw")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The file formats of audit logs and risk registers.
AUDIT = _struct(
    event_id=T.StringType(),
    timestamp=T.StringType(),
    actor=T.StringType(),
    action=T.StringType(),
    resource=T.StringType(),
    resource_version=T.StringType(),
    result=T.StringType(),
    correlation_id=T.StringType(),
    metadata=T.MapType(T.StringType(), T.StringType()),
    previous_hash=T.StringType(),
    event_hash=T.StringType(),
)

RISKS = _struct(
    risk_id=T.StringType(),
    category=T.StringType(),
    title=T.StringType(),
    likelihood=T.IntegerType(),
    impact=T.IntegerType(),
    inherent_risk=T.StringType(),
    control=T.StringType(),
    residual_risk=T.StringType(),
    owner=T.StringType(),
    status=T.StringType(),
    evidence=T.StringType(),
)

# The four published record contracts.
CONTRACTS: dict[str, dict] = {
    "generation": {
        "required": [
            "timestamp_utc",
            "asset_id",
            "technology",
            "power_mw",
            "energy_mwh",
            "availability",
            "source_id",
            "quality_flag",
            "is_synthetic",
        ],
        "min_length": {"asset_id": 3},
        "enum": {"technology": TECHNOLOGIES, "quality_flag": QUALITY_FLAGS},
        "minimum": {"power_mw": -0.001, "availability": 0.0, "curtailment_mw": 0.0},
        "maximum": {"availability": 1.0},
        "columns": None,
    },
    "weather": {
        "required": ["timestamp_utc", "station_id", "temperature_c", "wind_speed_ms", "source_id"],
        "min_length": {"station_id": 1},
        "enum": {},
        "minimum": {
            "temperature_c": -60.0,
            "wind_speed_ms": 0.0,
            "irradiance_wm2": 0.0,
            "cloud_cover_fraction": 0.0,
        },
        "maximum": {
            "temperature_c": 70.0,
            "wind_speed_ms": 100.0,
            "irradiance_wm2": 1600.0,
            "cloud_cover_fraction": 1.0,
        },
        "columns": [
            "timestamp_utc",
            "station_id",
            "temperature_c",
            "wind_speed_ms",
            "irradiance_wm2",
            "cloud_cover_fraction",
            "source_id",
            "is_synthetic",
        ],
    },
    "price": {
        "required": ["timestamp_utc", "market", "price_eur_mwh", "source_id"],
        "min_length": {},
        "enum": {"market": ("day_ahead", "intraday", "synthetic_reference")},
        "minimum": {"price_eur_mwh": -1000.0},
        "maximum": {"price_eur_mwh": 10000.0},
        "columns": ["timestamp_utc", "market", "price_eur_mwh", "source_id", "is_synthetic"],
    },
    "prediction": {
        "required": [
            "timestamp_utc",
            "asset_id",
            "horizon_hours",
            "p10_mw",
            "p50_mw",
            "p90_mw",
            "model_version",
        ],
        "min_length": {"asset_id": 1},
        "enum": {},
        "minimum": {"horizon_hours": 1, "p10_mw": 0.0, "p50_mw": 0.0, "p90_mw": 0.0},
        "maximum": {"horizon_hours": 168},
        "columns": [
            "timestamp_utc",
            "asset_id",
            "horizon_hours",
            "p10_mw",
            "p50_mw",
            "p90_mw",
            "model_version",
            "is_synthetic",
        ],
    },
}
