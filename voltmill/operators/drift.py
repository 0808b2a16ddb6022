"""Population stability and drift status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.operators.marts import unpivot
from voltmill.operators.quantiles import exact_quantiles
from voltmill.operators.series import number_rows
from voltmill.schemas import CALENDAR_FEATURES, FEATURES, RENEWABLE

# Bins, share floor and thresholds.
BINS = 10
SHARE_FLOOR = 1e-6
WATCH = 0.10
ALERT = 0.25


def psi(df: DataFrame, by: Sequence[str], value: str = "value", current: str = "is_current", bins: int = BINS) -> DataFrame:
    """Population stability index per group; ``by`` must be a small vocabulary.

    ``current`` splits the rows into reference (false) and current (true).
    Bins are the exact reference deciles, closed on the left. The edges of a
    group are one short row, so the counting pass needs no shuffle of values:
    rows are reduced to (group, bin) counts on the map side.
    """
    by = list(by)
    finite = df.filter(
        F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != F.lit(float("inf")))
    ).select(*by, F.col(value).alias("_v"), F.col(current).alias("_cur"))
    probs = [k * (1.0 / bins) for k in range(bins)] + [1.0]
    edges = (
        exact_quantiles(finite.filter(~F.col("_cur")), by, "_v", probs, bounded_groups=True)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_set("quantile")).alias("_edges"))
    )
    # left join: a group without reference rows still gets its zero
    binned = finite.join(edges, by, "left").withColumn(
        "_bin",
        F.expr(
            "CASE WHEN size(_edges) >= 3 THEN"
            " size(filter(slice(_edges, 2, size(_edges) - 2), e -> e <= _v)) ELSE 0 END"
        ),
    )
    counts = binned.groupBy(*by, "_bin").agg(
        F.count_if(~F.col("_cur")).alias("r"),
        F.count_if(F.col("_cur")).alias("c"),
        F.max(F.coalesce(F.size("_edges"), F.lit(0))).alias("e"),
    )
    totals = counts.groupBy(*by).agg(
        F.sum("r").alias("reference_rows"),
        F.sum("c").alias("current_rows"),
        F.max("e").alias("_e"),
        F.collect_list(F.struct("r", "c")).alias("_bins"),
    )
    share = lambda n, total: F.greatest(n / total, F.lit(SHARE_FLOOR))

    def term(total: Column, item: Column) -> Column:
        reference = share(item["r"], F.col("reference_rows"))
        now = share(item["c"], F.col("current_rows"))
        return total + (now - reference) * F.ln(now / reference)

    enough = (
        (F.col("reference_rows") >= bins) & (F.col("current_rows") >= bins) & (F.col("_e") >= 3)
    )
    return totals.select(
        *by,
        F.when(enough, F.aggregate(F.sort_array("_bins"), F.lit(0.0), term)).otherwise(F.lit(0.0)).alias("psi"),
        "reference_rows",
        "current_rows",
    )


def drift_windows(
    features: DataFrame, current_days: int = 14, reference_days: int = 28,
    required: Sequence[str] = FEATURES, ts: str = "timestamp_utc",
) -> DataFrame:
    """Complete rows of the two windows per technology, with ``is_current``."""
    rows = features.filter(F.col("technology").isin(*RENEWABLE)).dropna(subset=list(required))
    # at most one row per renewable technology
    ends = F.broadcast(rows.groupBy("technology").agg(F.max(ts).alias("_end")))
    cutoff = F.col("_end") - F.expr(f"INTERVAL {int(current_days)} DAYS")
    return (
        rows.join(ends, "technology")
        .filter(F.col(ts) >= cutoff - F.expr(f"INTERVAL {int(reference_days)} DAYS"))
        .withColumn("is_current", F.col(ts) >= cutoff)
        .drop("_end")
    )


def feature_drift(windows: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """PSI of every feature, all features in one pass over the long form."""
    long = unpivot(windows, columns, "feature", "value", keep=["technology", "is_current"])
    return psi(long, ["technology", "feature"])


def target_drift(windows: DataFrame) -> DataFrame:
    """PSI of power over capacity."""
    ratio = F.try_divide(F.col("power_mw"), F.col("installed_capacity_mw"))
    return psi(windows.withColumn("value", ratio), ["technology"])


def prediction_halves(predictions: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Capacity-normalized predictions, the later half marked ``is_current``."""
    rows = predictions.filter(F.col("technology").isin(*RENEWABLE)).select(
        "technology",
        ts,
        "asset_id",
        F.try_divide(F.col("p50_mw"), F.col("installed_capacity_mw")).alias("value"),
    )
    sizes = rows.groupBy("technology").agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("_half")
    )
    # one bucket per hour: a bucket holds one row per asset
    numbered = number_rows(rows, ["technology"], ts, ["asset_id"], bucket_seconds=3600)
    # at most one row per renewable technology
    return numbered.join(F.broadcast(sizes), "technology").withColumn(
        "is_current", F.col("_pos") >= F.col("_half")
    )


def prediction_drift(predictions: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """PSI between the earlier and the later half of the predictions."""
    return psi(prediction_halves(predictions, ts), ["technology"])


def drift_report(windows: DataFrame, predictions: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Long report (technology, kind, feature, psi), all series in one PSI job."""
    ratio = F.try_divide(F.col("power_mw"), F.col("installed_capacity_mw"))
    long = unpivot(
        windows.withColumn("target", ratio), [*columns, "target"], "feature", "value",
        keep=["technology", "is_current"],
    ).unionByName(
        prediction_halves(predictions).select(
            "technology", "is_current", F.lit("prediction").alias("feature"), "value"
        )
    )
    kind = (
        F.when(F.col("feature").isin(*CALENDAR_FEATURES), "calendar")
        .when(F.col("feature").isin("target", "prediction"), F.col("feature"))
        .otherwise("feature")
    )
    return psi(long, ["technology", "feature"]).select("technology", kind.alias("kind"), "feature", "psi")


def status_of(value: Column) -> Column:
    return F.when(value >= ALERT, "alert").when(value >= WATCH, "watch").otherwise("stable")


def drift_status(report: DataFrame) -> DataFrame:
    """Worst PSI per technology, calendar features left out, and its status."""
    return (
        report.filter(F.col("kind") != "calendar")
        .groupBy("technology")
        .agg(F.max("psi").alias("max_psi"))
        .withColumn("status", status_of(F.col("max_psi")))
    )
