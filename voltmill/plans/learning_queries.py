"""Queries that fit models; those whose rows SQL cannot give are checked by invariants instead."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voltmill.operators import anomaly, isolation, models, trees
from voltmill.plans.registry import query
from voltmill.plans.telemetry import SILVER_SQL

SCALED = tuple(f"{c}_scaled" for c in anomaly.ANOMALY_FEATURES)


def isolated(t):
    scaled = anomaly.impute_and_scale(anomaly.residuals(t.silver_table))
    return isolation.isolation_forest(scaled, ["asset_id", "timestamp_utc"], SCALED)


@query("isolation_forest", "asset_id:s timestamp_utc:t anomaly_score:d isolation_score:i")
def _(t):
    return isolated(t)


@query(
    "layered_incidents",
    "asset_id:s technology:s started_at:t points:i mwh_at_risk:d severity:s labelled_cause:s",
)
def _(t):
    flagged = anomaly.flag_anomalies(isolated(t), "isolation_score")
    return anomaly.classify_incidents(anomaly.incidents(flagged))


@query(
    "candidate_metrics",
    "technology:s model:s validation_mae_mw:d mae_mw:d rmse_mw:d nmae:r skill_vs_persistence:r coverage_p10_p90:r test_rows:i",
)
def _(t):
    return models.train_forecasters(t.features, sizes=models.QUICK).metrics


@query(
    "forecast_evaluation",
    "asset_id:s timestamp_utc:t technology:s model:s power_mw:d p10_mw:d p50_mw:d p90_mw:d",
)
def _(t):
    return models.train_forecasters(t.features, sizes=models.QUICK).evaluation


@query(
    "recursive_forecast",
    "asset_id:s timestamp_utc:t technology:s horizon_hours:i adjusted_point_mw:d p10_mw:d p50_mw:d p90_mw:d model_name:s",
)
def _(t):
    training = models.train_forecasters(t.features, sizes=models.QUICK)
    return models.forecast_recursive(t.silver_table, training.champions, training.offsets)


@query(
    "batch_scoring",
    "asset_id:s timestamp_utc:t technology:s point_mw:d p10_mw:d p50_mw:d p90_mw:d rejection:s",
)
def _(t):
    training = models.train_forecasters(t.features, sizes=models.QUICK)
    status = {"solar": "approved", "wind": "pending"}
    approvals = t.spark.createDataFrame(
        [(name, fitted.name, status[name]) for name, fitted in training.champions.items()],
        "technology string, model string, approval_status string",
    )
    requests = t.features.filter(F.col("technology").isin("solar", "wind"))
    return models.score_batch(requests, training.champions, training.offsets, approvals)


@query("portfolio_challenger", "model:s mae_mw:d test_rows:i dataset_hash:s promotion_status:s")
def _(t):
    return models.train_challenger(t.silver_table)


@query(
    "quantile_forecast",
    "technology:s test_rows:i coverage:r mean_width_mw:d crossing_rate:r pinball_p10:d pinball_p50:d pinball_p90:d",
)
def _(t):
    return models.quantile_report(models.train_quantiles(t.features))


#: Upper edges of the bins in the check of the first splits.
SPLIT_EDGES = {
    "irradiance_wm2": [float(100 * k) for k in range(1, 11)],
    "temperature_c": [float(k) for k in range(11, 34, 2)],
    "cloud_cover_fraction": [k / 8 for k in range(1, 8)],
    "wind_speed_ms": [2.5 * k for k in range(1, 10)],
    "expected_power_mw": [float(12 * k) for k in range(1, 17)],
}


def _split_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT technology, id, power_mw, {i} AS f, '{c}' AS feature, len([e FOR e IN {edges} IF e < {c}]) AS bin FROM able" for i, (c, edges) in enumerate(SPLIT_EDGES.items())
    )

    def level(number: int) -> str:
        return f"""sums{number} AS (SELECT technology, node, f, feature, bin, count(*) AS n, sum(power_mw) AS y FROM nodes{number} GROUP BY ALL),
upto{number} AS (
  SELECT *, sum(n) OVER one AS nl, sum(y) OVER one AS yl, sum(n) OVER whole AS na, sum(y) OVER whole AS ya FROM sums{number}
  WINDOW one AS (PARTITION BY technology, node, f ORDER BY bin), whole AS (PARTITION BY technology, node, f)
),
best{number} AS (
  SELECT {number} AS level, technology, node, f, feature, bin, yl * yl / nl + (ya - yl) * (ya - yl) / (na - nl) - ya * ya / na AS gain,
    nl, na - nl AS nr, yl, ya - yl AS yr FROM upto{number} WHERE nl >= 20 AND na - nl >= 20
  QUALIFY row_number() OVER (PARTITION BY technology, node ORDER BY gain DESC, f, bin) = 1
)"""

    return f"""WITH {SILVER_SQL},
able AS (
  SELECT technology, row_number() OVER () AS id, power_mw, {", ".join(SPLIT_EDGES)} FROM silver
  WHERE quality_flag = 'valid' AND technology <> 'battery' AND power_mw IS NOT NULL
),
cells AS MATERIALIZED ({cells}),
nodes0 AS (SELECT *, 0 AS node FROM cells),
{level(0)},
sides AS (
  SELECT c.technology, c.id, CASE WHEN c.bin <= b.bin THEN 1 ELSE 2 END AS node FROM cells c JOIN best0 b ON b.technology = c.technology AND b.f = c.f
),
nodes1 AS (SELECT c.*, s.node FROM cells c JOIN sides s ON s.technology = c.technology AND s.id = c.id),
{level(1)}
SELECT * REPLACE (round(gain, 3) AS gain) FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1) AS both_levels"""


@query("tree_splits", "technology:s level:i node:i feature:s bin:i gain:d nl:i nr:i yl:d yr:d", _split_sql())
def _(t):
    edges = [np.array(e) for e in SPLIT_EDGES.values()]
    valid = t.silver_table.filter(F.col("quality_flag") == "valid")
    parts = [
        trees.first_splits(valid.filter(F.col("technology") == technology), list(SPLIT_EDGES), edges, "power_mw", 2, 20).withColumn("technology", F.lit(technology))
        for technology in ("solar", "wind")
    ]
    return parts[0].unionByName(parts[1]).withColumn("gain", F.round("gain", 3))
