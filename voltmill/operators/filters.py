"""Row filters, searches and small projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The selectable periods.
PERIOD_DAYS = {"24h": 1, "7d": 7, "30d": 30}


def recent(df: DataFrame, days: int, ts: str = "timestamp_utc") -> DataFrame:
    """Rows of the last ``days`` days before the newest row.

    The newest time is a scalar subquery, so the comparison is an ordinary
    filter that reaches the scan.
    """
    newest = df.agg(F.max(ts).alias("newest")).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def apply_filters(
    df: DataFrame,
    technology: str | None = None,
    region: str | None = None,
    period: str | None = None,
    ts: str = "timestamp_utc",
) -> DataFrame:
    """Technology, region and period choice; ``all`` or None keeps everything."""
    if technology and technology != "all":
        df = df.filter(F.col("technology") == technology)
    if region and region != "all":
        df = df.filter(F.col("region") == region)
    if period and period != "all":
        df = recent(df, PERIOD_DAYS[period], ts)
    return df


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows whose joined columns contain ``text``, ignoring case."""
    joined = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    return df.filter(F.contains(joined, F.lit(text.lower())))


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON form contains ``text``, ignoring case."""
    if not text:
        return df
    return df.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower())))


def semantic_metrics(gold: DataFrame) -> DataFrame:
    """Gold rows with the absolute error."""
    return gold.select(
        "date_hour",
        "technology",
        "energy_mwh",
        "mwh_at_risk",
        F.abs(F.col("actual_mw") - F.col("expected_mw")).alias("absolute_error_mw"),
        "availability",
    )


def flow_progress(events: DataFrame, details: str = "details", kind: str = "flow_progress") -> DataFrame:
    """Status and metrics of pipeline events of one kind, read from JSON text."""
    return events.filter(F.col("event_type") == kind).select(
        "*",
        F.get_json_object(details, f"$.{kind}.status").alias("status"),
        F.get_json_object(details, f"$.{kind}.metrics").alias("metrics"),
    )



def regions(assets: DataFrame) -> DataFrame:
    """Distinct regions in order."""
    return assets.select("region").distinct().orderBy("region")


def top_assets(assets: DataFrame, by: str = "mwh_at_risk", k: int = 5) -> DataFrame:
    """Top ``k`` assets, ties broken by id."""
    return assets.orderBy(F.col(by).desc_nulls_last(), "asset_id").limit(k)
