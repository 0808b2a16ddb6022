"""Contracts, scorecards, table checks and acceptance reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmill.schemas import CONTRACTS

SCORECARD_COLUMNS = (
    "timestamp_utc",
    "asset_id",
    "power_mw",
    "availability",
    "source_id",
    "quality_flag",
)
PASS_MARK = 99.0
CHECKS_PER_DATASET = 4


def contract_rules(contract: str | dict, columns: Sequence[str]) -> dict[str, Column]:
    """Named boolean columns, true where a row breaks the rule."""
    spec = CONTRACTS[contract] if isinstance(contract, str) else contract
    present = set(columns)
    rules: dict[str, Column] = {}
    for name in spec["required"]:
        rules[f"required:{name}"] = F.col(name).isNull() if name in present else F.lit(True)
    for name, length in spec["min_length"].items():
        if name in present:
            rules[f"min_length:{name}"] = F.length(name) < length
    for name, allowed in spec["enum"].items():
        if name in present:
            rules[f"enum:{name}"] = ~F.col(name).isin(*allowed)
    for name, low in spec["minimum"].items():
        if name in present:
            rules[f"minimum:{name}"] = F.col(name) < low
    for name, high in spec["maximum"].items():
        if name in present:
            rules[f"maximum:{name}"] = F.col(name) > high
    if spec["columns"] is not None:
        for name in sorted(present - set(spec["columns"])):
            rules[f"additional:{name}"] = F.lit(True)
    if {"p10_mw", "p50_mw", "p90_mw"} <= set(spec["required"]) & present:
        rules["order:quantiles"] = (F.col("p10_mw") > F.col("p50_mw")) | (
            F.col("p50_mw") > F.col("p90_mw")
        )
    return rules


def contract_violations(df: DataFrame, contract: str | dict) -> DataFrame:
    """Rows that break the contract, with the broken rules in ``violations``."""
    rules = contract_rules(contract, df.columns)
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def validate_contract(df: DataFrame, contract: str | dict) -> DataFrame:
    """Violations per rule, zero included: one aggregate pass, no exploding."""
    rules = contract_rules(contract, df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
    return counts.unpivot(["_rows"], list(rules), "rule", "violations").select(
        "rule", "violations", F.col("_rows").alias("row_count")
    )


def schema_fingerprint(df: DataFrame) -> str:
    """sha256 of the name-sorted column types; reads no rows."""
    shape = json.dumps({f.name: f.dataType.simpleString() for f in df.schema}, sort_keys=True)
    return hashlib.sha256(shape.encode()).hexdigest()


def _shape_text(text: str | None) -> str | None:
    def shape(value, depth):
        if depth >= 4 or not isinstance(value, (dict, list)):
            return type(value).__name__
        if isinstance(value, dict):
            return {key: shape(value[key], depth + 1) for key in sorted(value)}
        return [shape(item, depth + 1) for item in value[:1]]

    if text is None:
        return None
    try:
        return json.dumps(shape(json.loads(text), 0), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def json_shape(texts: pd.Series) -> pd.Series:
    """Structure of a JSON text down to four levels, without its values."""
    return texts.map(_shape_text)


def json_shape_hash(column: Column) -> Column:
    return F.sha2(json_shape(column), 256)


def shape_report(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How often every JSON structure occurs; more than one per source is a change."""
    return df.groupBy(*by, json_shape_hash(F.col(column)).alias("shape_hash")).agg(
        F.count(F.lit(1)).alias("n")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("asset_id", "timestamp_utc")) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
    )


def quantile_violations(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.col("p10_mw") > F.col("p50_mw"))
        | (F.col("p50_mw") > F.col("p90_mw"))
        | (F.col("p10_mw") < 0)
    )


def gold_checks(df: DataFrame) -> DataFrame:
    """Number of duplicated keys and of broken quantile rows."""
    duplicates = duplicate_keys(df).select(F.lit("duplicate_keys").alias("check_id"))
    broken = quantile_violations(df).select(F.lit("quantile_order").alias("check_id"))
    found = duplicates.unionByName(broken).groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    checks = df.sparkSession.createDataFrame(
        [("duplicate_keys",), ("quantile_order",)], "check_id string"
    )
    # two fixed rows on the broadcast side
    return (
        F.broadcast(checks)
        .join(found, "check_id", "left")
        .select("check_id", F.coalesce("n", F.lit(0)).alias("violations"))
        .withColumn("passed", F.col("violations") == 0)
    )


def silver_score(silver: DataFrame) -> DataFrame:
    """Completeness, validity, uniqueness and continuity of Silver.

    Rows are combined per key, then per asset, then in total, so distinct
    counts need neither an expanded copy of the rows nor one big set.
    """
    missing = sum((F.col(c).isNull().cast("long") for c in SCORECARD_COLUMNS), F.lit(0))
    per_key = silver.groupBy("asset_id", "timestamp_utc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing).alias("missing"),
        F.count_if(F.col("quality_flag") == "quarantined").alias("quarantined"),
    )
    per_asset = per_key.groupBy("asset_id").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("keys"),
        F.sum("missing").alias("missing"),
        F.sum("quarantined").alias("quarantined"),
        F.min("timestamp_utc").alias("first"),
        F.max("timestamp_utc").alias("last"),
    )
    total = per_asset.agg(
        F.sum("n").alias("n"),
        F.sum("keys").alias("keys"),
        F.sum("missing").alias("missing"),
        F.sum("quarantined").alias("quarantined"),
        F.count("asset_id").alias("assets"),
        ((F.unix_seconds(F.max("last")) - F.unix_seconds(F.min("first"))) / 3600 + 1).alias("hours"),
    )
    rows = F.greatest("n", F.lit(1))
    return (
        total.select(
            F.lit("SCADA Silver").alias("dataset"),
            F.least(
                F.lit(100.0), 100 * F.col("n") / F.greatest(F.col("assets") * F.col("hours"), F.lit(1.0))
            ).alias("freshness"),
            (100 * (1 - F.col("missing") / (rows * len(SCORECARD_COLUMNS)))).alias("completeness"),
            (100 * (1 - F.col("quarantined") / rows)).alias("validity"),
            (100 * (1 - (F.col("n") - F.col("keys")) / rows)).alias("uniqueness"),
        )
        .withColumn(
            "status",
            F.when(F.least("freshness", "completeness", "validity", "uniqueness") >= PASS_MARK, "passed")
            .otherwise("watch"),
        )
    )


def gold_score(gold: DataFrame) -> DataFrame:
    """The same scores for the forecast table."""
    cells = len(gold.columns)
    missing = sum((F.col(c).isNull().cast("long") for c in gold.columns), F.lit(0))
    ordered = (F.col("p10_mw") <= F.col("p50_mw")) & (F.col("p50_mw") <= F.col("p90_mw"))
    ordered = F.coalesce(ordered, F.lit(False))
    per_key = gold.groupBy("asset_id", "timestamp_utc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(missing).alias("missing"),
        F.count_if(ordered).alias("ordered"),
    )
    total = per_key.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("keys"),
        F.sum("missing").alias("missing"),
        F.sum("ordered").alias("ordered"),
    )
    rows = F.greatest("n", F.lit(1))
    return total.select(
        F.lit("Forecast Gold").alias("dataset"),
        F.lit(100.0).alias("freshness"),
        (100 * (1 - F.col("missing") / (rows * cells))).alias("completeness"),
        (100 * F.col("ordered") / rows).alias("validity"),
        (100 * (1 - (F.col("n") - F.col("keys")) / rows)).alias("uniqueness"),
        F.when(F.col("ordered") == F.col("n"), "passed").otherwise("failed").alias("status"),
    )


def source_scores(sources: DataFrame, now: Column | None = None) -> DataFrame:
    """One score row per verified source (name, status, extracted_at, records, checksum)."""
    clock = now if now is not None else F.current_timestamp()
    age_hours = (F.unix_seconds(clock) - F.unix_seconds(F.try_to_timestamp("extracted_at"))) / 3600
    full = F.when(F.col("records") > 0, 100.0).otherwise(0.0)
    return sources.filter(F.col("status") == "verified").select(
        F.concat("name", F.lit(" Bronze")).alias("dataset"),
        F.when(age_hours < 2, 100.0).otherwise(99.0).alias("freshness"),
        full.alias("completeness"),
        F.when(F.col("checksum").isNotNull(), 100.0).otherwise(0.0).alias("validity"),
        F.lit(100.0).alias("uniqueness"),
        F.when(F.col("records") > 0, "passed").otherwise("failed").alias("status"),
    )


def quality_scorecard(
    silver: DataFrame,
    gold: DataFrame,
    sources: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Score rows of Silver, Gold and every verified source."""
    card = silver_score(silver).unionByName(gold_score(gold))
    return card.unionByName(source_scores(sources, now)) if sources is not None else card


def quality_summary(scorecard: DataFrame, silver: DataFrame) -> DataFrame:
    """Executed and passed checks, quarantined rows and mean validity."""
    flagged = silver.agg(
        F.count_if(F.col("quality_flag") == "quarantined").alias("q"), F.count(F.lit(1)).alias("n")
    )
    executed = F.count(F.lit(1)) * CHECKS_PER_DATASET
    passed = F.count_if(F.col("status") == "passed") * CHECKS_PER_DATASET
    return scorecard.agg(
        executed.alias("checks_executed"),
        passed.alias("checks_passed"),
        (executed - passed).alias("checks_watch_or_failed"),
        F.avg("validity").alias("overall_validity"),
    ).withColumns(
        {
            "quarantined_rows": flagged.select("q").scalar(),
            "quarantined_rate": flagged.select(100 * F.col("q") / F.greatest("n", F.lit(1))).scalar(),
        }
    )


def acceptance_report(
    silver: DataFrame,
    gold: DataFrame,
    expected_assets: int,
    minimum_rows: int,
    found_ids: DataFrame | None = None,
    expected_ids: Sequence[str] = (),
) -> DataFrame:
    """Named pass/fail rows for a finished run."""
    per_key = silver.groupBy("asset_id", "timestamp_utc").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce("is_synthetic", F.lit(False))).alias("synthetic"),
    )
    per_asset = per_key.groupBy("asset_id").agg(
        F.sum("n").alias("n"), F.max("n").alias("copies"), F.bool_and("synthetic").alias("synthetic")
    )
    facts = per_asset.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) >= minimum_rows).alias("row_count"),
        (F.count("asset_id") == expected_assets).alias("asset_count"),
        F.coalesce(F.bool_and("synthetic"), F.lit(False)).alias("all_synthetic"),
        F.coalesce(F.max("copies") == 1, F.lit(False)).alias("unique_key"),
    ).withColumn(
        "quantile_order",
        quantile_violations(gold).agg((F.count(F.lit(1)) == 0).alias("ok")).scalar(),
    )
    names = ["row_count", "asset_count", "all_synthetic", "unique_key", "quantile_order"]
    if found_ids is not None:
        facts = facts.withColumn(
            "dataset_ids",
            id_differences(found_ids, expected_ids).agg((F.count(F.lit(1)) == 0).alias("ok")).scalar(),
        )
        names.append("dataset_ids")
    return facts.unpivot([], names, "check_id", "passed")


def id_differences(found: DataFrame, expected: Sequence[str], column: str = "dataset_id") -> DataFrame:
    """Ids that are missing or unexpected; empty when both sets are equal."""
    wanted = found.sparkSession.createDataFrame([(i,) for i in expected], f"{column} string")
    seen = found.select(column).distinct()
    missing = wanted.join(seen, column, "left_anti").withColumn("difference", F.lit("missing"))
    extra = seen.join(F.broadcast(wanted), column, "left_anti").withColumn(
        "difference", F.lit("unexpected")
    )
    return missing.unionByName(extra)


def flag_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("quality_flag").agg(F.count(F.lit(1)).alias("n"))


def freshness(df: DataFrame, ts: str = "date_hour") -> DataFrame:
    return df.agg(F.max(ts).alias("latest_hour"), F.count(F.lit(1)).alias("row_count"))
