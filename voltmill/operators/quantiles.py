"""Exact quantiles without holding a whole group in one task.

``percentile`` keeps every distinct value of a group in one hash map. The
function below does the same job in bounded pieces: distinct values are
counted first, a sketch proposes narrow brackets around the wanted ranks, the
brackets are counted exactly, and only the few brackets that really hold a
wanted rank are sorted. A poor sketch makes a bracket larger, never wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    accuracy: int = SKETCH_ACCURACY,
    bounded_groups: bool = False,
) -> DataFrame:
    """Rows (``*by``, ``prob``, ``quantile``), linear between order statistics.

    NULL and NaN values are ignored. Set ``bounded_groups`` where ``by`` comes
    from a fixed vocabulary: the per-group sketch is then broadcast. Otherwise
    the planner picks the join from the measured size.
    """
    by = list(by)
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    values = source.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    # one row per group: bounded by construction when ungrouped or declared so
    small = F.broadcast if bounded_groups or not by else (lambda side: side)
    margin = 2.0 / accuracy
    edge_probs = sorted(
        {min(max(p + sign * margin, 0.0), 1.0) for p in probs for sign in (-1, 1)}
    )
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx("_v", edge_probs, accuracy).alias("_edges")
    )
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    bracketed = (
        counted.join(small(sketch), keys)
        if by
        else counted.withColumn("_edges", sketch.select("_edges").scalar())
    )
    binned = bracketed.select(
        *keys, "_v", "_c", F.expr("size(filter(_edges, e -> e < _v))").alias("_bin")
    )
    # at most 2 * len(probs) + 1 bins per group, so they fit one row
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("m"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_bin").alias("b"), "m"))).alias("_bins"))
        .withColumn("_n", F.expr("aggregate(_bins, 0L, (a, x) -> a + x.m)"))
    )
    targets = (
        bins.select(*keys, "_bins", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("_r", F.col("prob") * (F.col("_n") - 1))
        .select("*", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))).alias("_rank"))
        .withColumn(
            "_at",
            F.expr(
                "aggregate(_bins, named_struct('b', -1, 's', 0L, 'e', 0L), (a, x) ->"
                " if(a.e > _rank, a, named_struct('b', x.b, 's', a.e, 'e', a.e + x.m)))"
            ),
        )
        .groupBy(*keys, F.col("_at.b").alias("_bin"))
        .agg(
            F.first("_at.s").alias("_start"),
            F.collect_list(F.struct("prob", "_r", "_rank")).alias("_targets"),
        )
    )
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v")
    picked = (
        binned.join(small(targets), [*keys, "_bin"])
        .withColumn("_hi", F.col("_start") + F.sum("_c").over(in_bin))
        .withColumn("_t", F.explode("_targets"))
        .filter((F.col("_t._rank") < F.col("_hi")) & (F.col("_t._rank") >= F.col("_hi") - F.col("_c")))
    )
    low = F.min_by("_v", "_t._rank")
    high = F.max_by("_v", "_t._rank")
    share = F.max(F.col("_t._r") - F.floor("_t._r"))
    return picked.groupBy(*keys, F.col("_t.prob").alias("prob")).agg(
        (low + (high - low) * share).alias("quantile")
    ).select(*by, "prob", "quantile")


def group_percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Quantiles for many groups that are each small (bounded by their key)."""
    array = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
    return df.groupBy(*by).agg(array.alias("quantiles"))


def score_totals(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    totals: Sequence[str],
    bins: int = 65_536,
) -> DataFrame:
    """Running totals over descending ``score`` in [0, 1], ties taken together.

    One row per distinct score with ``cum_<total>`` (this score included). The
    running sum is taken inside fixed score bins and shifted by the totals of
    all higher bins, so no task sees a whole group.
    """
    by = list(by)
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    distinct = source.groupBy(*keys, score).agg(*[F.sum(t).alias(t) for t in totals])
    binned = distinct.withColumn(
        "_bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    )
    per_bin = binned.groupBy(*keys, "_bin").agg(*[F.sum(t).alias(f"_b_{t}") for t in totals])
    above = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_bin").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for total in totals:
        per_bin = per_bin.withColumn(
            f"_s_{total}", F.coalesce(F.sum(f"_b_{total}").over(above), F.lit(0))
        )
    shifts = per_bin.select(*keys, "_bin", *[f"_s_{t}" for t in totals])
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.col(score).desc())
    joined = binned.join(shifts, [*keys, "_bin"])
    for total in totals:
        joined = joined.withColumn(
            f"cum_{total}", F.col(f"_s_{total}") + F.sum(total).over(inside)
        )
    return joined.select(*by, score, *totals, *[f"cum_{t}" for t in totals])
