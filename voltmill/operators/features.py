"""Causal features and series arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill.operators.series import (
    CHUNK_ROWS,
    drop_halo,
    lag_rows,
    number_rows,
    with_halo,
    with_time_halo,
)

LAGS = {"lag_1h_mw": 1, "lag_24h_mw": 24, "lag_168h_mw": 168}
ROLLING = "rolling_24h_mw"


def cyclical(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Hour and day of year as sine and cosine."""
    hour = F.hour(ts) * (2 * math.pi) / 24
    day = F.dayofyear(ts) * (2 * math.pi) / 365.25
    return df.withColumns(
        {
            "hour_sin": F.sin(hour),
            "hour_cos": F.cos(hour),
            "day_sin": F.sin(day),
            "day_cos": F.cos(day),
        }
    )


def lags_and_rolling(
    df: DataFrame,
    value: str = "power_mw",
    lags: dict[str, int] = LAGS,
    window: int = 24,
    min_periods: int = 6,
    rolling: str = ROLLING,
    mode: str = "rows",
    keys: Sequence[str] = ("asset_id",),
    ts: str = "timestamp_utc",
    chunk_rows: int = CHUNK_ROWS,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Lags and the mean of the previous ``window`` values, this row left out.

    ``rows`` counts readings, ``time`` counts hours. Both work on chunks of a
    series that carry a halo of earlier readings, so a long series is spread
    over many tasks and all columns share one sort per chunk.
    """
    keys = list(keys)
    longest = max([*lags.values(), window])
    if mode == "rows":
        chunks = with_halo(number_rows(df, keys, ts, bucket_seconds=bucket_seconds), longest, chunk_rows)
        ordered = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
        lagged = {name: F.lag(value, rows).over(ordered) for name, rows in lags.items()}
        frame = ordered.rowsBetween(-window, -1)
    elif mode == "time":
        chunks = with_time_halo(df, ts, longest * 3600, bucket_seconds, keys, chunk_rows)
        ordered = Window.partitionBy(*keys, "_chunk").orderBy("_epoch")
        lagged = {
            name: F.max(value).over(ordered.rangeBetween(-hours * 3600, -hours * 3600))
            for name, hours in lags.items()
        }
        frame = ordered.rangeBetween(-window * 3600, -1)
    else:
        raise ValueError("mode is 'rows' or 'time'")
    enough = F.count(value).over(frame) >= min_periods
    return drop_halo(
        chunks.select("*", *[c.alias(n) for n, c in lagged.items()],
                      F.when(enough, F.avg(value).over(frame)).alias(rolling))
    )


def build_features(df: DataFrame, mode: str = "rows", **options) -> DataFrame:
    """Calendar columns, lags and rolling mean: the feature vector's columns."""
    return cyclical(lags_and_rolling(df, mode=mode, **options))


def capacity_ratio(df: DataFrame, power: str = "power_mw", capacity: str = "installed_capacity_mw") -> DataFrame:
    return df.withColumn("capacity_ratio", F.try_divide(F.col(power), F.col(capacity)))


def integrate_energy(
    df: DataFrame,
    power: str = "power_mw",
    ts: str = "timestamp_utc",
    first_hours: float | None = None,
    keys: Sequence[str] = ("asset_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Energy of each reading over the time since the reading before it."""
    timed = lag_rows(df, keys, ts, {"_previous": (ts, 1)}, chunk_rows=chunk_rows)
    hours = (F.unix_seconds(ts) - F.unix_seconds("_previous")) / F.lit(3600.0)
    if first_hours is not None:
        hours = F.coalesce(hours, F.lit(float(first_hours)))
    return (
        timed.withColumn("interval_hours", hours)
        .withColumn("energy_integral_mwh", F.col(power) * F.col("interval_hours"))
        .drop("_previous")
    )
