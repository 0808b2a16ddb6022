"""Normalization, deduplication, range flags and gap repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.operators.series import carry_bounds, number_rows
from voltmill.schemas import GAP_COLUMNS
from voltmill.session import materialize

KEYS = ("asset_id", "timestamp_utc")
# Tolerances of the physical range rule.
POWER_FLOOR_MW = -0.001
POWER_CEILING_RATIO = 1.03


def normalize_utc(df: DataFrame, column: str = "timestamp_utc", source_tz: str = "UTC") -> DataFrame:
    """Event time as UTC; NaN measures become NULL so aggregates skip them."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    clean = {name: F.when(~F.isnan(name), F.col(name)) for name in doubles}
    return df.withColumns({**clean, column: F.to_utc_timestamp(F.col(column), source_tz)})


def dedup_latest(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order_by: Sequence[str] = ("ingested_at", "event_sequence"),
    hash_ties: bool = False,
) -> DataFrame:
    """Keep the newest copy per key.

    The ``row_number = 1`` filter is applied on the map side as well, so a key
    with very many copies leaves each map task as one row. ``hash_ties`` makes
    the order total where ``order_by`` is not; it reads every column.
    """
    order = [F.col(c).desc_nulls_last() for c in order_by]
    if hash_ties:
        order.append(F.xxhash64(*[F.col(c) for c in df.columns]).desc())
    newest_first = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_copy", F.row_number().over(newest_first))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


def physical_violation(null_policy: str = "valid", exempt_battery: bool = True) -> Column:
    """True where a reading is physically impossible; never NULL."""
    low = F.col("power_mw") < POWER_FLOOR_MW
    high = F.col("power_mw") > F.col("installed_capacity_mw") * POWER_CEILING_RATIO
    not_battery = F.col("technology") != "battery"
    power = not_battery & (low | high) if exempt_battery else (not_battery & low) | high
    availability = (F.col("availability") < 0) | (F.col("availability") > 1)
    return F.coalesce(availability, F.lit(null_policy == "quarantine")) | F.coalesce(
        power,
        (not_battery if null_policy == "quarantine" else F.lit(False)),
        F.lit(False),
    )


def flag_physical(
    df: DataFrame,
    null_policy: str = "valid",
    exempt_battery: bool = True,
    keep_existing: bool = False,
) -> DataFrame:
    """Set ``quality_flag``; an incoming flag survives with ``keep_existing``."""
    if null_policy not in ("valid", "quarantine"):
        raise ValueError("null_policy is 'valid' or 'quarantine'")
    fine = (
        F.coalesce(F.col("quality_flag"), F.lit("valid"))
        if keep_existing and "quality_flag" in df.columns
        else F.lit("valid")
    )
    return df.withColumn(
        "quality_flag",
        F.when(physical_violation(null_policy, exempt_battery), "quarantined").otherwise(fine),
    )


def clean_generation(df: DataFrame, null_policy: str = "valid") -> DataFrame:
    """Normalize, deduplicate and flag."""
    return flag_physical(dedup_latest(normalize_utc(df)), null_policy)


def fill_short_gaps(
    df: DataFrame,
    columns: Sequence[str] = GAP_COLUMNS,
    limit: int = 3,
    ffill: int = 1,
    keys: Sequence[str] = ("asset_id",),
    ts: str = "timestamp_utc",
    time_aware: bool = False,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Fill the first cells of each gap.

    The first ``limit`` missing cells are interpolated between the readings on
    both sides, by row position or, with ``time_aware``, by elapsed time. The
    next ``ffill`` cells repeat the last filled one (``time_aware`` goes on
    interpolating there). A gap without a later
    reading repeats the last reading; a gap without an earlier one stays.

    Readings next to a bucket edge are carried over it by ``carry_bounds``, so
    no task holds more than one bucket of a series: about ``CHUNK_ROWS`` rows,
    unless ``bucket_seconds`` fixes its length. The numbered rows are
    stored once, as bounds and frames both read them.
    """
    keys = list(keys)
    rows = materialize(number_rows(df, keys, ts, bucket_seconds=bucket_seconds), "numbered")
    seconds = F.unix_seconds(F.col(ts))
    anchors = {
        f"_a_{c}": F.when(
            F.col(c).isNotNull(),
            F.struct(F.col("_pos").alias("p"), seconds.alias("s"), F.col(c).alias("v")),
        )
        for c in columns
    }
    bounds = carry_bounds(rows, keys, "_pos", anchors)
    # both directions are running frames: one pass each, in opposite order
    running = (Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*keys, "_bucket")
    earlier = inside.orderBy("_pos").rowsBetween(*running)
    later = inside.orderBy(F.col("_pos").desc()).rowsBetween(*running)
    seen = rows.select(
        "*", *[F.last(anchors[f"_a_{c}"], ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in columns]
    ).select(
        "*", *[F.last(anchors[f"_a_{c}"], ignorenulls=True).over(later).alias(f"_n_{c}") for c in columns]
    )
    joined = seen.join(bounds, [*keys, "_bucket"])
    filled = {}
    for column in columns:
        before = F.coalesce(F.col(f"_p_{column}"), F.col(f"_a_{column}_before"))
        after = F.coalesce(F.col(f"_n_{column}"), F.col(f"_a_{column}_after"))
        steps = F.col("_pos") - before["p"]
        if time_aware:
            done, span = seconds - before["s"], after["s"] - before["s"]
        else:
            done, span = F.least(steps, F.lit(limit)), after["p"] - before["p"]
        straight = before["v"] + (after["v"] - before["v"]) * done / span
        filled[column] = F.coalesce(
            F.col(column),
            F.when(steps <= limit + ffill, F.coalesce(straight, before["v"])),
        )
    return joined.withColumns(filled).select(*df.columns)


def clean_silver(df: DataFrame, null_policy: str = "valid", time_aware: bool = False) -> DataFrame:
    """Bronze to Silver: normalize, deduplicate, flag, repair short gaps."""
    present = [c for c in GAP_COLUMNS if c in df.columns]
    return fill_short_gaps(clean_generation(df, null_policy), present, time_aware=time_aware)


# The expectations of the Silver table.
SILVER_RULES = {
    "asset_id_present": "asset_id IS NOT NULL",
    "timestamp_present": "timestamp_utc IS NOT NULL",
    "availability_range": "availability BETWEEN 0 AND 1",
    "known_technology": "technology IN ('solar', 'wind', 'battery')",
}
POWER_RULE = {
    "physical_power_range": "technology = 'battery' OR (power_mw >= -0.001D"
    " AND power_mw <= installed_capacity_mw * 1.03D)",
}


def violations(rules: dict[str, str]) -> Column:
    """Sorted names of the rules that are false for a row; NULL is no violation."""
    return F.array_compact(
        F.array(*[F.when(~F.expr(rules[name]), F.lit(name)) for name in sorted(rules)])
    )


def quarantine(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Rows that break any rule, with the broken rules listed."""
    return df.withColumn("violations", violations(rules or {**SILVER_RULES, **POWER_RULE})).filter(
        F.size("violations") > 0
    )


def expect(df: DataFrame, rules: dict[str, str], mode: str = "warn"):
    """Apply expectations; returns the frame and an ``Observation`` of counts.

    ``warn`` keeps all rows, ``drop`` keeps rows for which every rule is true,
    ``fail`` stops the job at the first row that breaks a rule.
    """
    from pyspark.sql import Observation

    observed = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")] + [
        F.count_if(~F.coalesce(F.expr(text), F.lit(False))).alias(name)
        for name, text in rules.items()
    ]
    watched = df.observe(observed, *metrics)
    if mode == "warn":
        return watched, observed
    holds = F.lit(True)
    for text in rules.values():
        holds = holds & F.coalesce(F.expr(text), F.lit(False))
    if mode == "drop":
        return watched.filter(holds), observed
    if mode == "fail":
        checked = F.when(holds, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"expectation failed: {', '.join(rules)}")).cast("boolean")
        )
        return watched.filter(checked), observed
    raise ValueError("mode is 'warn', 'drop' or 'fail'")
