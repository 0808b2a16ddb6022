"""Drift, evaluation, anomaly and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.operators import anomaly, drift, forecast, inspection
from voltmill.operators.joins import label_intervals
from voltmill.plans.feature_queries import FEATURES_SQL, WINDOWS_SQL, scenario_windows
from voltmill.plans.quality_queries import EVAL_SQL, FILLED_SQL, evaluation
from voltmill.plans.registry import query
from voltmill.plans.telemetry import SILVER_SQL, TELEMETRY_SQL
from voltmill.schemas import FEATURES
from voltmill.session import materialize

DRIFT_SQL = (
    FEATURES_SQL
    + """,
complete AS (
  SELECT * FROM features WHERE technology IN ('solar', 'wind') AND lag_1h_mw IS NOT NULL AND lag_24h_mw IS NOT NULL
    AND lag_168h_mw IS NOT NULL AND rolling_24h_mw IS NOT NULL
),
ends AS (SELECT technology, max(timestamp_utc) - INTERVAL 14 DAY AS cutoff FROM complete GROUP BY technology),
windowed AS (
  SELECT c.*, c.timestamp_utc >= e.cutoff AS is_current FROM complete c JOIN ends e ON c.technology = e.technology
  WHERE c.timestamp_utc >= e.cutoff - INTERVAL 28 DAY
)"""
)


def psi_sql(long: str) -> str:
    """PSI per (technology, feature) over a frame ``long`` (technology, feature, value, is_current)."""
    probs = ", ".join(str(p) for p in [k * 0.1 for k in range(10)] + [1.0])
    return f"""edges AS (
  SELECT technology, feature, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS e
  FROM {long} WHERE NOT is_current AND value IS NOT NULL GROUP BY 1, 2
),
binned AS (
  SELECT l.technology, l.feature, l.is_current,
    CASE WHEN len(e) >= 3 THEN len(list_filter(e[2:-2], lambda x: x <= l.value)) ELSE 0 END AS bin, len(e) AS n_edges
  FROM {long} l LEFT JOIN edges ON l.technology = edges.technology AND l.feature = edges.feature WHERE l.value IS NOT NULL
),
counted AS (
  SELECT technology, feature, bin, count(*) FILTER (WHERE NOT is_current) AS r, count(*) FILTER (WHERE is_current) AS c,
    max(n_edges) AS n_edges FROM binned GROUP BY 1, 2, 3
),
shares AS (
  SELECT *, sum(r) OVER g AS rn, sum(c) OVER g AS cn FROM counted WINDOW g AS (PARTITION BY technology, feature)
),
psi_rows AS (
  SELECT technology, feature, CASE WHEN max(rn) >= 10 AND max(cn) >= 10 AND max(n_edges) >= 3 THEN
      sum((greatest(c / cn, CAST(0.000001 AS DOUBLE)) - greatest(r / rn, CAST(0.000001 AS DOUBLE)))
        * ln(greatest(c / cn, CAST(0.000001 AS DOUBLE)) / greatest(r / rn, CAST(0.000001 AS DOUBLE)))) ELSE 0 END AS psi,
    max(rn) AS reference_rows, max(cn) AS current_rows
  FROM shares GROUP BY technology, feature
)"""


LONG_FEATURES_SQL = "long_features AS (" + " UNION ALL ".join(
    f"SELECT technology, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, is_current FROM windowed" for f in FEATURES
) + ")"


def windows(t):
    return materialize(drift.drift_windows(t.features), "drift-windows")


@query(
    "psi_features",
    "technology:s feature:s psi:r reference_rows:i current_rows:i",
    f"WITH {DRIFT_SQL}, {LONG_FEATURES_SQL}, {psi_sql('long_features')} SELECT * FROM psi_rows",
)
def _(t):
    return drift.feature_drift(windows(t))


TARGET_LONG = """long_target AS (SELECT technology, 'target' AS feature, power_mw / installed_capacity_mw AS value, is_current FROM windowed)"""


@query(
    "target_drift",
    "technology:s psi:r reference_rows:i current_rows:i",
    f"WITH {DRIFT_SQL}, {TARGET_LONG}, {psi_sql('long_target')} SELECT * FROM psi_rows",
)
def _(t):
    return drift.target_drift(windows(t))


PREDICTION_LONG = """long_prediction AS (
  SELECT technology, 'prediction' AS feature, p50_mw / installed_capacity_mw AS value,
    row_number() OVER (PARTITION BY technology ORDER BY timestamp_utc, asset_id)
      > greatest(1, count(*) OVER (PARTITION BY technology) // 2) AS is_current
  FROM evaluation
)"""


@query(
    "prediction_drift",
    "technology:s psi:r reference_rows:i current_rows:i",
    f"WITH {EVAL_SQL}, {PREDICTION_LONG}, {psi_sql('long_prediction')} SELECT * FROM psi_rows",
)
def _(t):
    return drift.prediction_drift(evaluation(t))


ALL_LONG = f"""{LONG_FEATURES_SQL}, {TARGET_LONG}, {PREDICTION_LONG},
everything AS (SELECT * FROM long_features UNION ALL SELECT * FROM long_target UNION ALL SELECT * FROM long_prediction)"""
EVALUATION_ONLY = EVAL_SQL[len(SILVER_SQL) + 1 :]


@query(
    "drift_status",
    "technology:s max_psi:r status:s",
    f"""WITH {DRIFT_SQL}, {EVALUATION_ONLY}, {ALL_LONG}, {psi_sql('everything')}
    SELECT technology, max(psi) AS max_psi,
      CASE WHEN max(psi) >= CAST(0.25 AS DOUBLE) THEN 'alert' WHEN max(psi) >= CAST(0.1 AS DOUBLE) THEN 'watch' ELSE 'stable' END AS status
    FROM psi_rows WHERE feature NOT IN ('hour_sin', 'hour_cos', 'day_sin', 'day_cos') GROUP BY technology""",
)
def _(t):
    return drift.drift_status(drift.drift_report(windows(t), evaluation(t)))


@query(
    "review_gate",
    "models:i drifted:i request_challenger:b gate:s",
    f"""WITH {DRIFT_SQL}, {EVALUATION_ONLY}, {ALL_LONG}, {psi_sql('everything')},
    s AS (SELECT technology, max(psi) AS m FROM psi_rows WHERE feature NOT IN ('hour_sin', 'hour_cos', 'day_sin', 'day_cos') GROUP BY 1)
    SELECT count(*) AS models, count(*) FILTER (WHERE m >= CAST(0.1 AS DOUBLE)) AS drifted, bool_or(m >= CAST(0.1 AS DOUBLE)) AS request_challenger,
      'manual_approval_required' AS gate FROM s""",
)
def _(t):
    return drift_gate(t)


def drift_gate(t):
    return forecast.review_gate(drift.drift_status(drift.drift_report(windows(t), evaluation(t))))


# Inspections: documents with a label; the score follows from the text length.
INSPECT_SQL = """inspected AS (
  SELECT d.doc_id, 'VIS-' || CAST(d.doc_id AS VARCHAR) AS inspection_id, d.lang AS cell_type, d.source,
    CASE WHEN quality = 1 THEN 'functional' ELSE 'defective' END AS label,
    CAST(n_chars * 7 % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, CAST(n_chars % 60 AS DOUBLE) AS contrast
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
judged AS (
  SELECT *, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 'defective' ELSE 'functional' END AS prediction,
    CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN score ELSE 1 - score END AS confidence,
    CASE WHEN label = 'defective' THEN 1 ELSE 0 END AS positive FROM inspected
)"""


def inspected(t):
    score = (F.col("n_chars") * 7 % 1001).cast("double") / F.lit(1000.0)
    return (
        t.read("documents")
        .join(t.read("labels"), "doc_id")
        .select(
            "doc_id",
            F.concat(F.lit("VIS-"), F.col("doc_id").cast("string")).alias("inspection_id"),
            F.col("lang").alias("cell_type"),
            "source",
            F.when(F.col("quality") == 1, "functional").otherwise("defective").alias("label"),
            score.alias("score"),
            (F.col("n_chars") % 60).cast("double").alias("contrast"),
        )
        .withColumns(
            {
                "prediction": F.when(F.col("score") >= 0.5, "defective").otherwise("functional"),
                "confidence": F.when(F.col("score") >= 0.5, F.col("score")).otherwise(1 - F.col("score")),
                "positive": (F.col("label") == "defective").cast("int"),
            }
        )
    )


def report_sql(by: str) -> str:
    key = f"{by} AS slice" if by else "'all' AS slice"
    return f"""sliced AS (SELECT *, {key} FROM judged),
domain AS (SELECT slice, label FROM sliced UNION SELECT slice, prediction FROM sliced),
report AS (
  SELECT d.slice, d.label,
    count(*) FILTER (WHERE s.label = d.label) AS support,
    count(*) FILTER (WHERE s.prediction = d.label) AS predicted,
    count(*) FILTER (WHERE s.label = d.label AND s.prediction = d.label) AS hits
  FROM domain d JOIN sliced s ON s.slice = d.slice GROUP BY 1, 2
),
scores AS (
  SELECT slice, label, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1 FROM report
)"""


REPORT_SPEC = "label:s precision:r recall:r f1:r support:i"


@query(
    "classification_report",
    REPORT_SPEC,
    f"WITH {INSPECT_SQL}, {report_sql('')} SELECT * FROM scores",
)
def _(t):
    return inspection.classification_report(inspected(t), "label", "prediction")


@query(
    "classification_slices",
    "cell_type:s " + REPORT_SPEC,
    f"WITH {INSPECT_SQL}, {report_sql('cell_type')} SELECT slice AS cell_type, * FROM scores",
)
def _(t):
    return inspection.classification_report(inspected(t), "label", "prediction", ["cell_type"])


@query(
    "classification_summary",
    "cell_type:s accuracy:r balanced_accuracy:r macro_f1:r n:i",
    f"""WITH {INSPECT_SQL}, {report_sql('cell_type')} SELECT slice AS cell_type, sum(hits) / sum(support) AS accuracy,
      avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, avg(f1) AS macro_f1, sum(support) AS n FROM scores GROUP BY slice""",
)
def _(t):
    report = inspection.classification_report(inspected(t), "label", "prediction", ["cell_type"])
    return inspection.classification_summary(report, ["cell_type"])


@query(
    "confusion_matrix",
    "truth:s predicted:s n:i",
    f"WITH {INSPECT_SQL} SELECT label AS truth, prediction AS predicted, count(*) AS n FROM judged GROUP BY 1, 2",
)
def _(t):
    return inspection.confusion_matrix(inspected(t), "label", "prediction")


@query(
    "calibration_error",
    "expected_calibration_error:r",
    f"""WITH {INSPECT_SQL}, bins AS (SELECT CAST(i AS DOUBLE) / 10 AS lo, CAST(i + 1 AS DOUBLE) / 10 AS hi FROM range(10) r(i)),
    per_bin AS (SELECT lo, count(*) AS n, avg(CAST(label = prediction AS INT)) AS acc, avg(confidence) AS conf
      FROM judged JOIN bins ON confidence > lo AND confidence <= hi GROUP BY lo)
    SELECT sum(n * abs(acc - conf)) / (SELECT count(*) FROM judged) AS expected_calibration_error FROM per_bin""",
)
def _(t):
    return inspection.calibration_error(inspected(t), "label", "prediction", "confidence")


@query(
    "brier_score",
    "cell_type:s brier_score:r",
    f"WITH {INSPECT_SQL} SELECT cell_type, avg(pow(positive - score, 2)) AS brier_score FROM judged GROUP BY cell_type",
)
def _(t):
    return inspection.brier(inspected(t), "positive", "score", ["cell_type"])


@query(
    "roc_auc",
    "roc_auc:r average_precision:r positives:i negatives:i",
    f"""WITH {INSPECT_SQL}, groups AS (SELECT score, CAST(sum(positive) AS DOUBLE) AS pos, CAST(sum(1 - positive) AS DOUBLE) AS neg FROM judged GROUP BY score),
    cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM groups WINDOW w AS (ORDER BY score DESC))
    SELECT sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos * cp / (cp + cn)) / max(p) AS average_precision,
      max(p) AS positives, max(n) AS negatives FROM cum""",
)
def _(t):
    return inspection.ranking_scores(inspected(t), "positive", "score")


CLASS_SCORES_SQL = """classes AS (SELECT DISTINCT cell_type AS label FROM judged),
long_scores AS (
  SELECT c.label, CASE WHEN j.cell_type = c.label THEN 1 ELSE 0 END AS truth,
    CASE WHEN j.cell_type = c.label THEN 1 - j.score / 2 ELSE j.score END AS score
  FROM judged j CROSS JOIN classes c
)"""


def class_scores(t):
    """One row per item and class; the four classes are a fixed vocabulary."""
    rows = inspected(t)
    label = F.explode(F.array(*[F.lit(c) for c in ("de", "en", "es", "fr")]))
    return (
        rows.select("cell_type", F.col("score").alias("_s"), label.alias("label"))
        .withColumn("truth", (F.col("cell_type") == F.col("label")).cast("int"))
        .withColumn("score", F.when(F.col("truth") == 1, 1 - F.col("_s") / 2).otherwise(F.col("_s")))
    )


@query(
    "macro_auc",
    "roc_auc:r average_precision:r",
    f"""WITH {INSPECT_SQL}, {CLASS_SCORES_SQL}, groups AS (
      SELECT label, score, CAST(sum(truth) AS DOUBLE) AS pos, CAST(sum(1 - truth) AS DOUBLE) AS neg FROM long_scores GROUP BY 1, 2),
    cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS p, sum(neg) OVER g AS n
      FROM groups WINDOW w AS (PARTITION BY label ORDER BY score DESC), g AS (PARTITION BY label)),
    per AS (SELECT label, sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n)) AS auc, sum(pos * cp / (cp + cn)) / max(p) AS ap FROM cum GROUP BY label)
    SELECT avg(auc) AS roc_auc, avg(ap) AS average_precision FROM per""",
)
def _(t):
    return inspection.macro_ranking(class_scores(t))


@query(
    "brier_multiclass",
    "brier_score:r",
    f"WITH {INSPECT_SQL}, {CLASS_SCORES_SQL} SELECT avg(pow(truth - score, 2)) AS brier_score FROM long_scores",
)
def _(t):
    return inspection.brier(class_scores(t), "truth", "score")


def unit_sql(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text} || ':42'), 1, 12)) AS BIGINT) / CAST({16**12} AS DOUBLE)"


def cut_sql(prob: float) -> str:
    return f"quantile_cont(u, {prob})"


@query(
    "stratified_split",
    "doc_id:i label:s part:s",
    f"""WITH {INSPECT_SQL}, hashed AS (SELECT *, {unit_sql('CAST(doc_id AS VARCHAR)')} AS u FROM judged),
    cuts AS (SELECT label, cell_type, {cut_sql(0.2)} AS a, {cut_sql(0.36)} AS b FROM hashed GROUP BY 1, 2)
    SELECT doc_id, h.label, CASE WHEN u <= a THEN 'test' WHEN u <= b THEN 'validation' ELSE 'train' END AS part
    FROM hashed h JOIN cuts c ON h.label = c.label AND h.cell_type = c.cell_type""",
)
def _(t):
    return inspection.split(inspected(t), ["doc_id"], strata=["label", "cell_type"])


@query(
    "group_split",
    "doc_id:i source:s part:s",
    f"""WITH {INSPECT_SQL}, hashed AS (SELECT *, {unit_sql('source')} AS u FROM judged),
    cuts AS (SELECT {cut_sql(0.2)} AS a, {cut_sql(0.36)} AS b FROM (SELECT DISTINCT source, u FROM hashed))
    SELECT doc_id, source, CASE WHEN u <= a THEN 'test' WHEN u <= b THEN 'validation' ELSE 'train' END AS part FROM hashed, cuts""",
)
def _(t):
    return inspection.split(inspected(t), ["doc_id"], group=["source"])


@query(
    "triage",
    "inspection_id:s status:s quality_score:d severity:s review_required:b",
    f"""WITH {INSPECT_SQL}, q AS (SELECT *, contrast < 5 AS low FROM judged)
    SELECT inspection_id, CASE WHEN low THEN 'review_required' ELSE 'completed' END AS status,
      CASE WHEN low THEN round_even(contrast / 5, 3) END AS quality_score,
      CASE WHEN NOT low AND prediction = 'defective' THEN CASE WHEN confidence >= CAST(0.85 AS DOUBLE) THEN 'high' ELSE 'medium' END ELSE 'low' END AS severity,
      low OR prediction = 'defective' OR confidence < CAST(0.8 AS DOUBLE) AS review_required FROM q""",
)
def _(t):
    return inspection.triage(inspected(t))


REVIEWS_SQL = """reviews AS (
  SELECT event_id AS review_id, 'VIS-' || CAST(event_id % 1500 AS VARCHAR) AS inspection_id,
    CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' ELSE 'other' END AS action,
    CASE WHEN event_id % 8 = 2 THEN 'defective' END AS corrected_label, 'user-' || CAST(user_id AS VARCHAR) AS reviewer, ts AS reviewed_at FROM events
)"""


def reviews(t):
    event = F.col("event_id")
    return t.read("events").select(
        event.alias("review_id"),
        F.concat(F.lit("VIS-"), (event % 1500).cast("string")).alias("inspection_id"),
        F.when(event % 4 == 0, "approve").when(event % 4 == 1, "reject").when(event % 4 == 2, "correct")
        .otherwise("other").alias("action"),
        F.when(event % 8 == 2, "defective").alias("corrected_label"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("reviewer"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
    )


@query(
    "apply_reviews",
    "inspection_id:s label:s review_status:s final_label:s",
    f"""WITH {INSPECT_SQL}, {REVIEWS_SQL}, latest AS (SELECT * FROM reviews
      WHERE action IN ('approve', 'reject') OR (action = 'correct' AND corrected_label IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY reviewed_at DESC, review_id DESC) = 1)
    SELECT j.inspection_id, label, coalesce(action, 'pending') AS review_status,
      CASE WHEN action = 'correct' THEN corrected_label ELSE label END AS final_label
    FROM judged j LEFT JOIN latest l ON j.inspection_id = l.inspection_id""",
)
def _(t):
    return inspection.apply_reviews(inspected(t), reviews(t))


@query(
    "review_violations",
    "review_id:i rejection:s",
    f"""WITH {REVIEWS_SQL} SELECT review_id, CASE WHEN action = 'other' THEN 'unknown action' ELSE 'corrected_label is required' END AS rejection
    FROM reviews WHERE action = 'other' OR (action = 'correct' AND corrected_label IS NULL)""",
)
def _(t):
    return inspection.review_violations(reviews(t)).filter(F.col("rejection").isNotNull())


@query(
    "class_counts",
    "label:s position:i n:i",
    """SELECT label, position, count(d.known) AS n FROM (VALUES ('normal', 0, 'en'), ('microcrack', 1, 'fr'), ('hotspot', 2, 'de'), ('soiling', 3, 'xx'), ('other', 4, '?')) c(label, position, lang)
    LEFT JOIN (SELECT CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE '?' END AS known FROM documents) d ON d.known = c.lang GROUP BY 1, 2""",
)
def _(t):
    from voltmill.operators.marts import class_counts

    label = F.when(F.col("lang") == "en", "normal").when(F.col("lang") == "fr", "microcrack").when(
        F.col("lang") == "de", "hotspot"
    )
    return class_counts(t.read("documents").select(label.alias("label")))


# --- anomalies ---

ANOMALY_SQL = (
    SILVER_SQL
    + """,
scored AS (
  SELECT *, power_mw - expected_power_mw AS residual_mw, (power_mw - expected_power_mw) / greatest(installed_capacity_mw, 1) AS residual_ratio
  FROM silver WHERE technology IN ('solar', 'wind')
),
flagged AS (
  SELECT *, coalesce(residual_ratio < CAST(-0.14 AS DOUBLE), FALSE) AS residual_alert,
    coalesce(residual_ratio < CAST(-0.14 AS DOUBLE), FALSE) OR anomaly_type <> 'none' AS is_anomaly FROM scored
),
grouped AS (
  SELECT asset_id, technology, min(timestamp_utc) AS started_at, max(timestamp_utc) AS last_seen_at, count(*) AS points,
    min(residual_mw) AS worst_residual_mw, arg_min(installed_capacity_mw, (timestamp_utc, event_sequence)) AS capacity_mw,
    coalesce(arg_min(anomaly_type, (timestamp_utc, event_sequence)) FILTER (WHERE anomaly_type <> 'none'), 'underperformance') AS labelled_cause
  FROM flagged WHERE is_anomaly AND timestamp_utc >= (SELECT max(timestamp_utc) FROM flagged) - INTERVAL 14 DAY GROUP BY 1, 2
),
classified AS (
  SELECT *, greatest(coalesce(-worst_residual_mw * points, 0), 0) AS mwh_at_risk,
    'INC-' || lpad(CAST(row_number() OVER (ORDER BY asset_id) + 240 AS VARCHAR), 4, '0') AS incident_id,
    CASE labelled_cause WHEN 'soiling' THEN 'Schedule thermographic inspection and verify soiling ratio'
      WHEN 'yaw_misalignment' THEN 'Inspect yaw calibration during next safe access window'
      WHEN 'frozen_sensor' THEN 'Quarantine sensor signal and use fallback weather feature'
      ELSE 'Review residual evidence and operational alarms' END AS recommended_action FROM grouped
),
incidents AS (
  SELECT *, CASE WHEN mwh_at_risk > 55 THEN 'critical' WHEN mwh_at_risk > 18 THEN 'high' WHEN mwh_at_risk > 5 THEN 'medium' ELSE 'low' END AS severity,
    least(greatest(CAST(0.62 AS DOUBLE) + mwh_at_risk / capacity_mw / 8, CAST(0.62 AS DOUBLE)), CAST(0.98 AS DOUBLE)) AS confidence FROM classified
)"""
)


def found_incidents(t):
    return anomaly.classify_incidents(
        anomaly.incidents(anomaly.flag_anomalies(anomaly.residuals(t.silver)))
    )


@query(
    "residuals",
    "event_sequence:i residual_mw:d residual_ratio:r residual_alert:b is_anomaly:b",
    f"WITH {ANOMALY_SQL} SELECT * FROM flagged",
)
def _(t):
    return anomaly.flag_anomalies(anomaly.residuals(t.silver))


@query(
    "incidents",
    "asset_id:s technology:s started_at:t last_seen_at:t points:i worst_residual_mw:d capacity_mw:d labelled_cause:s"
    " mwh_at_risk:d severity:s confidence:r incident_id:s recommended_action:s",
    f"WITH {ANOMALY_SQL} SELECT * FROM incidents",
)
def _(t):
    return found_incidents(t)


@query(
    "top_incidents",
    "asset_id:s mwh_at_risk:d estimated_impact_eur:d",
    f"""WITH {ANOMALY_SQL} SELECT asset_id, mwh_at_risk, mwh_at_risk * CAST(61.4 AS DOUBLE) AS estimated_impact_eur FROM incidents
    ORDER BY mwh_at_risk DESC, last_seen_at DESC, asset_id LIMIT 8""",
)
def _(t):
    return anomaly.top_incidents(found_incidents(t))


@query(
    "severity_counts",
    "severity:s position:i n:i",
    f"""WITH {ANOMALY_SQL} SELECT c.severity, position, count(i.severity) AS n
    FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('other', 4)) c(severity, position)
    LEFT JOIN incidents i ON i.severity = c.severity GROUP BY 1, 2""",
)
def _(t):
    from voltmill.operators.marts import severity_counts

    return severity_counts(found_incidents(t))


@query(
    "incident_matrix",
    "severity:s labelled_cause:s n:i",
    f"WITH {ANOMALY_SQL} SELECT severity, labelled_cause, count(*) AS n FROM incidents GROUP BY 1, 2",
)
def _(t):
    from voltmill.operators.marts import incident_matrix

    return incident_matrix(found_incidents(t))


SCALE = ("residual_ratio", "availability", "temperature_c", "wind_speed_ms")


@query(
    "robust_scaling",
    "event_sequence:i " + " ".join(f"{c}_scaled:d" for c in SCALE),
    f"""WITH {ANOMALY_SQL},
    med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}_m' for c in SCALE)} FROM scored),
    imputed AS (SELECT event_sequence, {', '.join(f'coalesce({c}, {c}_m) AS {c}' for c in SCALE)} FROM scored, med),
    q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3' for c in SCALE)} FROM imputed)
    SELECT event_sequence, {', '.join(f'({c} - {c}_2) / CASE WHEN {c}_3 - {c}_1 = 0 THEN 1 ELSE {c}_3 - {c}_1 END AS {c}_scaled' for c in SCALE)} FROM imputed, q""",
)
def _(t):
    return anomaly.impute_and_scale(anomaly.residuals(t.silver_table))


LABELLED_SQL = f"""collapsed AS (
  SELECT *, count(*) OVER (PARTITION BY asset_id, timestamp_utc) AS copies FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY asset_id, timestamp_utc ORDER BY ingested_at DESC, event_sequence DESC) = 1
),
timeline AS (
  SELECT *, epoch(ingested_at) // 1 - epoch(timestamp_utc) AS delay, lag(timestamp_utc) OVER s AS prev_ts, lag(event_sequence) OVER s AS prev_seq,
    lag(schema_version) OVER s AS prev_schema, count(*) OVER f AS n4, count(temperature_c) OVER f AS c4,
    min(temperature_c) OVER f AS lo4, max(temperature_c) OVER f AS hi4,
    regr_slope(temperature_c, CAST(pos AS DOUBLE)) OVER f AS slope4
  FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_utc) - 1 AS pos FROM collapsed)
  WINDOW s AS (PARTITION BY asset_id ORDER BY pos), f AS (PARTITION BY asset_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
),
ruled AS (
  SELECT *, concat_ws(',',
    CASE WHEN epoch(timestamp_utc) - epoch(prev_ts) > 7200 THEN 'communication_loss' END,
    CASE WHEN curtailment_flag THEN 'curtailment' END,
    CASE WHEN copies > 1 THEN 'duplicates' END,
    CASE WHEN prev_seq > event_sequence THEN 'event_reordering' END,
    CASE WHEN n4 = 4 AND c4 = 4 AND lo4 = hi4 THEN 'frozen_sensor' END,
    CASE WHEN technology = 'wind' AND vibration_rms >= CAST(7.1 AS DOUBLE) THEN 'high_vibration' END,
    CASE WHEN technology = 'solar' AND expected_power_mw > 0 AND power_mw < expected_power_mw * CAST(0.6 AS DOUBLE) THEN 'inverter_loss' END,
    CASE WHEN delay >= 172800 THEN 'late_backfill' END,
    CASE WHEN delay BETWEEN 7200 AND 172799 THEN 'late_timestamps' END,
    CASE WHEN power_mw > installed_capacity_mw * CAST(1.2 AS DOUBLE) AND power_mw <= installed_capacity_mw * 100 THEN 'malicious_tampering' END,
    CASE WHEN power_mw IS NULL THEN 'missing_values' END,
    CASE WHEN NOT availability BETWEEN 0 AND 1 OR temperature_c > 70 THEN 'out_of_range' END,
    CASE WHEN inverter_temperature_c > 100 THEN 'overtemperature' END,
    CASE WHEN technology = 'wind' AND vibration_rms >= CAST(4.5 AS DOUBLE) AND rotor_speed_rpm < 8 THEN 'rotor_imbalance' END,
    CASE WHEN prev_schema <> schema_version THEN 'schema_change' END,
    CASE WHEN n4 = 4 AND slope4 >= CAST(3.5 AS DOUBLE) THEN 'sensor_drift' END,
    CASE WHEN technology = 'solar' AND (power_mw - expected_power_mw) / greatest(installed_capacity_mw, 1) < CAST(-0.14 AS DOUBLE) THEN 'soiling' END,
    CASE WHEN availability = 0 AND power_mw = 0 THEN 'total_outage' END,
    CASE WHEN power_mw > installed_capacity_mw * 100 OR measurement_unit <> 'MW' THEN 'unit_change' END,
    CASE WHEN technology = 'wind' AND abs(yaw_error_deg) >= 20 THEN 'yaw_error' END) AS detected FROM timeline
)"""


@query(
    "rule_detectors",
    "asset_id:s timestamp_utc:t copies:i detected:s",
    f"WITH {TELEMETRY_SQL}, {LABELLED_SQL} SELECT * FROM ruled",
)
def _(t):
    return anomaly.detect_rules(t.telemetry, chunk_rows=300).withColumn(
        "detected", F.array_join("detected", ",")
    )


@query(
    "detection_counts",
    "asset_id:s window_start:t rule:s points:i",
    f"""WITH {TELEMETRY_SQL}, {LABELLED_SQL} SELECT asset_id, window_start, rule, count(*) AS points
    FROM (SELECT asset_id, date_trunc('day', timestamp_utc) AS window_start, unnest(string_split(detected, ',')) AS rule
      FROM ruled WHERE detected <> '') GROUP BY ALL""",
)
def _(t):
    return anomaly.detection_counts(anomaly.detect_rules(t.telemetry))


# Labels for the scorecard: every scenario window is called a soiling, yaw
# error, curtailment, overtemperature or frozen-sensor episode.
KINDS = ("soiling", "yaw_error", "curtailment", "overtemperature", "frozen_sensor")


@query(
    "detection_scorecard",
    "scenario:s true_positives:i false_positives:i false_negatives:i precision:r recall:r",
    f"""WITH {TELEMETRY_SQL}, {LABELLED_SQL}, {WINDOWS_SQL}, labels_ AS (
      SELECT r.asset_id, r.timestamp_utc, arg_min(CASE w.window_id % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END, w.window_id) AS label
      FROM ruled r JOIN windows w ON r.asset_id = w.asset_id AND r.timestamp_utc >= w.window_start AND r.timestamp_utc < w.window_end GROUP BY 1, 2),
    labelled AS (SELECT r.*, l.label FROM ruled r LEFT JOIN labels_ l ON r.asset_id = l.asset_id AND r.timestamp_utc = l.timestamp_utc),
    hits AS (SELECT asset_id, timestamp_utc, unnest(string_split(detected, ',')) AS scenario FROM labelled WHERE detected <> ''),
    pairs AS (SELECT coalesce(h.scenario, l.label) AS scenario, l.label IS NOT NULL AS is_, h.scenario IS NOT NULL AS found_
      FROM hits h FULL JOIN (SELECT * FROM labelled WHERE label IS NOT NULL) l
      ON h.asset_id = l.asset_id AND h.timestamp_utc = l.timestamp_utc AND h.scenario = l.label)
    SELECT scenario, count(*) FILTER (WHERE is_ AND found_) AS true_positives, count(*) FILTER (WHERE NOT is_) AS false_positives,
      count(*) FILTER (WHERE NOT found_) AS false_negatives,
      coalesce(count(*) FILTER (WHERE is_ AND found_) / nullif(count(*) FILTER (WHERE found_), 0), 0) AS precision,
      coalesce(count(*) FILTER (WHERE is_ AND found_) / nullif(count(*) FILTER (WHERE is_), 0), 0) AS recall
    FROM pairs GROUP BY scenario""",
)
def _(t):
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("window_id") % 5).cast("int"))
    found = anomaly.detect_rules(t.telemetry)
    labels = (
        label_intervals(found.select("asset_id", "timestamp_utc"), scenario_windows(t))
        .groupBy("asset_id", "timestamp_utc")
        .agg(F.min_by(kind, "window_id").alias("scenario"))
    )
    return anomaly.detection_scorecard(found.join(labels, ["asset_id", "timestamp_utc"], "left"))


# --- forecasts ---

SPLIT_SQL = (
    FEATURES_SQL
    + """,
usable AS (
  SELECT * FROM features WHERE technology IN ('solar', 'wind') AND lag_1h_mw IS NOT NULL AND lag_24h_mw IS NOT NULL
    AND lag_168h_mw IS NOT NULL AND rolling_24h_mw IS NOT NULL
),
split AS (
  SELECT u.*, c.cutoff, u.timestamp_utc >= c.cutoff AS is_test FROM usable u
  JOIN (SELECT technology, max(timestamp_utc) - INTERVAL 14 DAY AS cutoff FROM usable GROUP BY 1) c ON u.technology = c.technology
),
cells AS (
  SELECT asset_id, isodow(timestamp_utc) AS wd, extract(hour FROM timestamp_utc) AS h, avg(power_mw) AS cell FROM split WHERE NOT is_test GROUP BY 1, 2, 3
),
per_asset AS (SELECT asset_id, avg(power_mw) AS mean_power FROM split WHERE NOT is_test GROUP BY 1),
baselined AS (
  SELECT s.*, lag_1h_mw AS persistence_1h, lag_24h_mw AS same_hour_24h, lag_168h_mw AS same_hour_168h,
    least(greatest(coalesce(cell, mean_power, 0), 0), installed_capacity_mw) AS hour_weekday_mean,
    least(greatest(expected_power_mw, 0), installed_capacity_mw) AS physical_expected_power
  FROM split s LEFT JOIN cells c ON c.asset_id = s.asset_id AND c.wd = isodow(s.timestamp_utc) AND c.h = extract(hour FROM s.timestamp_utc)
    LEFT JOIN per_asset p ON p.asset_id = s.asset_id
  WHERE is_test
)"""
)


def split(t):
    return forecast.holdout_split(t.features)


@query(
    "holdout_split",
    "asset_id:s timestamp_utc:t cutoff:t is_test:b",
    f"WITH {SPLIT_SQL} SELECT * FROM split",
)
def _(t):
    return split(t)


@query(
    "time_folds",
    "technology:s fold:i role:s n:i first_ts:t last_ts:t",
    f"""WITH {SILVER_SQL}, b AS (SELECT technology, min(epoch(timestamp_utc)) AS f, (max(epoch(timestamp_utc)) + 1 - min(epoch(timestamp_utc))) / 4 AS step
      FROM silver WHERE technology IN ('solar', 'wind') GROUP BY 1),
    r AS (SELECT s.technology, timestamp_utc, fold, CASE WHEN epoch(timestamp_utc) < f + step * fold - 86400 THEN 'fit'
        WHEN epoch(timestamp_utc) >= f + step * fold AND epoch(timestamp_utc) < f + step * (fold + 1) THEN 'validate' END AS role
      FROM silver s JOIN b ON s.technology = b.technology CROSS JOIN (VALUES (1), (2), (3)) v(fold))
    SELECT technology, fold, role, count(*) AS n, min(timestamp_utc) AS first_ts, max(timestamp_utc) AS last_ts FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    return forecast.time_folds(t.silver).groupBy("technology", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp_utc").alias("first_ts"),
        F.max("timestamp_utc").alias("last_ts"),
    )


@query(
    "baselines",
    "asset_id:s timestamp_utc:t " + " ".join(f"{b}:d" for b in forecast.BASELINES),
    f"WITH {SPLIT_SQL} SELECT * FROM baselined",
)
def _(t):
    return forecast.baselines(split(t))


@query(
    "baseline_metrics",
    "technology:s baseline:s mae_mw:d rmse_mw:d",
    f"WITH {SPLIT_SQL} "
    + " UNION ALL ".join(
        f"SELECT technology, '{b}' AS baseline, avg(abs(power_mw - {b})) AS mae_mw, sqrt(avg(pow(power_mw - {b}, 2))) AS rmse_mw FROM baselined GROUP BY 1"
        for b in forecast.BASELINES
    ),
)
def _(t):
    return forecast.baseline_metrics(forecast.baselines(split(t)))


# Raw quantiles around the expected power, some of them crossed on purpose.
RAW_SQL = """raw AS (
  SELECT *, expected_power_mw * CAST(event_sequence % 7 AS DOUBLE) / 4 AS p10_mw, expected_power_mw AS p50_mw,
    expected_power_mw * CAST(event_sequence % 11 AS DOUBLE) / 4 AS p90_mw FROM {source}
),
repaired AS (
  SELECT * REPLACE (q[1] AS p10_mw, q[2] AS p50_mw, q[3] AS p90_mw) FROM (
    SELECT *, p10_mw > p50_mw OR p50_mw > p90_mw AS was_crossed,
      list_sort([least(greatest(p10_mw, 0), installed_capacity_mw), least(greatest(p50_mw, 0), installed_capacity_mw),
        least(greatest(p90_mw, 0), installed_capacity_mw)]) AS q FROM raw)
)"""


def raw_quantiles(df):
    expected, event = F.col("expected_power_mw"), F.col("event_sequence")
    return df.withColumns(
        {
            "p10_mw": expected * (event % 7).cast("double") / 4,
            "p50_mw": expected,
            "p90_mw": expected * (event % 11).cast("double") / 4,
        }
    )


@query(
    "repair_quantiles",
    "event_sequence:i was_crossed:b p10_mw:d p50_mw:d p90_mw:d",
    f"WITH {SILVER_SQL}, {RAW_SQL.format(source='silver')} SELECT * FROM repaired",
)
def _(t):
    return forecast.repair_quantiles(raw_quantiles(t.silver))


METRICS_SQL = """SELECT {by}, avg(abs(p50_mw - power_mw)) AS mae_mw, sqrt(avg(pow(p50_mw - power_mw, 2))) AS rmse_mw,
  avg(abs(p50_mw - power_mw) / installed_capacity_mw) AS nmae, sqrt(avg(pow(p50_mw - power_mw, 2))) / avg(installed_capacity_mw) AS nrmse,
  avg(p50_mw - power_mw) AS bias_mw, 1 - avg(abs(p50_mw - power_mw)) / avg(abs(power_mw - lag_24h_mw)) AS skill_vs_persistence,
  avg(CAST(power_mw >= p10_mw AND power_mw <= p90_mw AS INT)) AS coverage_p10_p90,
  avg(greatest(CAST(0.1 AS DOUBLE) * (power_mw - p10_mw), CAST(-0.9 AS DOUBLE) * (power_mw - p10_mw))) AS pinball_p10,
  avg(greatest(CAST(0.5 AS DOUBLE) * (power_mw - p50_mw), CAST(-0.5 AS DOUBLE) * (power_mw - p50_mw))) AS pinball_p50,
  avg(greatest(CAST(0.9 AS DOUBLE) * (power_mw - p90_mw), CAST(-0.1 AS DOUBLE) * (power_mw - p90_mw))) AS pinball_p90,
  avg(p90_mw - p10_mw) AS interval_width_mw, avg(CAST(p10_mw > p90_mw AS INT)) AS quantile_crossing_rate, count(*) AS test_rows
FROM {source} WHERE power_mw IS NOT NULL AND p50_mw IS NOT NULL AND lag_24h_mw IS NOT NULL GROUP BY {by}"""
METRICS_SPEC = (
    "mae_mw:d rmse_mw:d nmae:r nrmse:r bias_mw:d skill_vs_persistence:r coverage_p10_p90:r pinball_p10:d pinball_p50:d"
    " pinball_p90:d interval_width_mw:d quantile_crossing_rate:r test_rows:i"
)


@query(
    "forecast_metrics",
    "technology:s " + METRICS_SPEC,
    f"WITH {SPLIT_SQL}, {RAW_SQL.format(source='baselined')} {METRICS_SQL.format(by='technology', source='repaired')}",
)
def _(t):
    return forecast.forecast_metrics(
        forecast.repair_quantiles(raw_quantiles(split(t).filter(F.col("is_test"))))
    )


@query(
    "horizon_metrics",
    "technology:s bucket:s mae_mw:d observations:i",
    f"""WITH {EVAL_SQL}, b AS (SELECT *, CASE WHEN horizon_hours <= 6 THEN '0–6 h' WHEN horizon_hours <= 12 THEN '7–12 h' WHEN horizon_hours <= 18 THEN '13–18 h'
        WHEN horizon_hours <= 24 THEN '19–24 h' WHEN horizon_hours <= 36 THEN '25–36 h' WHEN horizon_hours <= 48 THEN '37–48 h' END AS bucket FROM evaluation)
    SELECT technology, bucket, avg(abs(power_mw - p50_mw)) AS mae_mw, count(*) AS observations FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return forecast.horizon_metrics(evaluation(t))


# Candidate metric rows: each baseline acts as a candidate model, validated on
# the first test week and scored on all of it.
CANDIDATES_SQL = (
    SPLIT_SQL
    + """,
candidates AS ("""
    + " UNION ALL ".join(
        f"""SELECT technology, '{b}' AS model, avg(abs(power_mw - {b})) FILTER (WHERE timestamp_utc < cutoff + INTERVAL 7 DAY) AS validation_mae_mw,
      avg(abs(power_mw - {b})) AS mae_mw, avg(abs(power_mw - {b}) / installed_capacity_mw) AS nmae,
      1 - avg(abs(power_mw - {b})) / avg(abs(power_mw - lag_24h_mw)) AS skill_vs_persistence,
      avg(CAST(power_mw BETWEEN {b} * CAST(0.5 AS DOUBLE) AND {b} * CAST(1.5 AS DOUBLE) AS INT)) AS coverage_p10_p90 FROM baselined GROUP BY 1"""
        for b in forecast.BASELINES
    )
    + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY validation_mae_mw, mae_mw, model) AS selection_rank FROM candidates)"""
)


def candidates(t):
    scored = forecast.baselines(split(t))
    y, capacity = F.col("power_mw"), F.col("installed_capacity_mw")
    early = F.col("timestamp_utc") < F.col("cutoff") + F.expr("INTERVAL 7 DAYS")
    rows = scored.unpivot(
        ["technology", "timestamp_utc", "cutoff", "power_mw", "installed_capacity_mw", "lag_24h_mw"],
        list(forecast.BASELINES),
        "model",
        "p",
    )
    error = F.abs(y - F.col("p"))
    inside = y.between(F.col("p") * 0.5, F.col("p") * 1.5).cast("double")
    return rows.groupBy("technology", "model").agg(
        F.avg(F.when(early, error)).alias("validation_mae_mw"),
        F.avg(error).alias("mae_mw"),
        F.avg(error / capacity).alias("nmae"),
        (1 - F.avg(error) / F.avg(F.abs(y - F.col("lag_24h_mw")))).alias("skill_vs_persistence"),
        F.avg(inside).alias("coverage_p10_p90"),
    )


@query(
    "rank_models",
    "technology:s model:s validation_mae_mw:d mae_mw:d selection_rank:i alias:s",
    f"""WITH {CANDIDATES_SQL} SELECT *, CASE selection_rank WHEN 1 THEN 'Champion' WHEN 2 THEN 'Challenger' END AS alias FROM ranked""",
)
def _(t):
    return forecast.rank_models(candidates(t))


@query(
    "promotion_gates",
    "technology:s model:s positive_skill_vs_persistence:b nmae_below_10_percent:b interval_coverage_recorded:b manual_approval_required:b gates_passed:b",
    f"""WITH {CANDIDATES_SQL} SELECT technology, model, skill_vs_persistence > 0 AS positive_skill_vs_persistence, nmae < CAST(0.1 AS DOUBLE) AS nmae_below_10_percent,
      coverage_p10_p90 > 0 AS interval_coverage_recorded, TRUE AS manual_approval_required,
      skill_vs_persistence > 0 AND nmae < CAST(0.1 AS DOUBLE) AND coverage_p10_p90 > 0 AS gates_passed FROM candidates""",
)
def _(t):
    return forecast.promotion_gates(candidates(t))


APPROVAL_SQL = """artifacts AS (SELECT technology, sha256(model) AS sha256 FROM ranked WHERE selection_rank = 1),
approvals AS (SELECT technology, model, 'approved' AS status, sha256(CASE WHEN technology = 'solar' THEN model ELSE 'other' END) AS artifact_sha256,
  'reviewer' AS approver FROM ranked WHERE selection_rank = 1)"""


def approvals(rows):
    champions = forecast.rank_models(rows).filter(F.col("selection_rank") == 1)
    artifacts = champions.select("technology", F.sha2("model", 256).alias("sha256"))
    signed = F.when(F.col("technology") == "solar", F.col("model")).otherwise("other")
    granted = champions.select(
        "technology",
        "model",
        F.lit("approved").alias("status"),
        F.sha2(signed, 256).alias("artifact_sha256"),
        F.lit("reviewer").alias("approver"),
    )
    return champions.select("technology", "model"), artifacts, granted


@query(
    "approval_status",
    "technology:s model:s sha256:s approval_status:s approved_by:s",
    f"""WITH {CANDIDATES_SQL}, {APPROVAL_SQL} SELECT r.technology, r.model, a.sha256,
      CASE WHEN p.artifact_sha256 = a.sha256 AND p.model = r.model THEN 'approved' ELSE 'pending' END AS approval_status,
      CASE WHEN p.artifact_sha256 = a.sha256 AND p.model = r.model THEN approver ELSE 'Pending manual approval' END AS approved_by
    FROM ranked r JOIN artifacts a ON a.technology = r.technology JOIN approvals p ON p.technology = r.technology WHERE selection_rank = 1""",
)
def _(t):
    return forecast.approval_status(*approvals(materialize(candidates(t), "candidates")))


@query(
    "approval_violations",
    "technology:s model:s rejection:s",
    f"""WITH {CANDIDATES_SQL} SELECT c.technology, c.model, CASE WHEN length(c.model) < 14 THEN 'RATIONALE_TOO_SHORT'
      WHEN c.model <> r.model THEN 'NOT_THE_CHAMPION' END AS rejection
    FROM candidates c JOIN ranked r ON r.technology = c.technology AND r.selection_rank = 1""",
)
def _(t):
    rows = materialize(candidates(t), "candidates")
    champions = forecast.rank_models(rows).filter(F.col("selection_rank") == 1)
    requests = rows.select(
        "technology",
        "model",
        F.lit("reviewer").alias("approver"),
        F.concat(F.lit("based"), F.lit(" "), "model").alias("rationale"),
    )
    return forecast.approval_violations(requests, champions)


@query(
    "model_health",
    "technology:s model:s alias:s selection_rank:i approval_status:s artifact_sha256:s validation_delta_percent:d drift_status:s drift_max_psi:r",
    f"""WITH {CANDIDATES_SQL}, {APPROVAL_SQL}, {EVALUATION_ONLY}, complete AS (SELECT * FROM usable),
    ends AS (SELECT technology, max(timestamp_utc) - INTERVAL 14 DAY AS cutoff FROM complete GROUP BY technology),
    windowed AS (SELECT c.*, c.timestamp_utc >= e.cutoff AS is_current FROM complete c JOIN ends e ON c.technology = e.technology
      WHERE c.timestamp_utc >= e.cutoff - INTERVAL 28 DAY), {ALL_LONG}, {psi_sql('everything')},
    d AS (SELECT technology, max(psi) AS m FROM psi_rows WHERE feature NOT IN ('hour_sin', 'hour_cos', 'day_sin', 'day_cos') GROUP BY 1),
    best AS (SELECT technology, validation_mae_mw AS b FROM ranked WHERE selection_rank = 1)
    SELECT r.technology, r.model, CASE selection_rank WHEN 1 THEN 'Champion' ELSE 'Challenger' END AS alias, selection_rank,
      CASE WHEN selection_rank = 2 THEN 'not_requested' WHEN p.artifact_sha256 = a.sha256 THEN 'approved' ELSE 'pending' END AS approval_status,
      CASE WHEN selection_rank = 1 THEN a.sha256 END AS artifact_sha256,
      CASE WHEN selection_rank = 2 THEN (validation_mae_mw / greatest(b, CAST(0.000000001 AS DOUBLE)) - 1) * 100 END AS validation_delta_percent,
      CASE WHEN m >= CAST(0.25 AS DOUBLE) THEN 'alert' WHEN m >= CAST(0.1 AS DOUBLE) THEN 'watch' ELSE 'stable' END AS drift_status, m AS drift_max_psi
    FROM ranked r JOIN best ON best.technology = r.technology JOIN artifacts a ON a.technology = r.technology
      JOIN approvals p ON p.technology = r.technology JOIN d ON d.technology = r.technology WHERE selection_rank <= 2""",
)
def _(t):
    status = drift.drift_status(drift.drift_report(windows(t), evaluation(t)))
    rows = materialize(candidates(t), "candidates")
    _, artifacts, granted = approvals(rows)
    return forecast.model_health(rows, artifacts, granted, status)


@query(
    "newest_version",
    "model_name:s versions_found:i challenger_alias:i",
    "SELECT p_type AS model_name, count(*) AS versions_found, max(p_size) AS challenger_alias FROM part GROUP BY 1",
)
def _(t):
    versions = t.read("part").select(
        F.col("p_type").alias("model_name"), F.col("p_size").cast("string").alias("version")
    )
    return forecast.newest_version(versions)


@query(
    "verify_predictions",
    "check_id:s passed:b",
    f"""WITH {SILVER_SQL}, {RAW_SQL.format(source='silver')}
    SELECT 'point_prediction_finite' AS check_id, bool_and(coalesce(isfinite(power_mw), FALSE)) AS passed FROM repaired
    UNION ALL SELECT 'quantiles_finite', bool_and(isfinite(p10_mw) AND isfinite(p50_mw) AND isfinite(p90_mw)) FROM repaired
    UNION ALL SELECT 'quantiles_ordered', bool_and(p10_mw <= p50_mw AND p50_mw <= p90_mw) FROM repaired
    UNION ALL SELECT 'feature_schema_matches', TRUE""",
)
def _(t):
    rows = forecast.repair_quantiles(raw_quantiles(t.silver)).withColumn("point_mw", F.col("power_mw"))
    return forecast.verify_predictions(rows, FEATURES, FEATURES)


# --- images: an embedding is read as an eight pixel wide gray image ---


@query(
    "image_statistics",
    "vec_id:i mean:d std:d p10:d p50:d p90:d entropy:d skewness:d kurtosis:d edge_share:d mean_gradient:d",
    """WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((CAST(x AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 255), 0), 255)) AS p FROM embeddings),
    cells AS (SELECT vec_id, i - 1 AS i, p[i] AS raw, p[i] / 255 AS v, len(p) AS n,
        CASE WHEN (i - 1) % 8 > 0 THEN p[i - 1] / 255 END AS l, CASE WHEN (i - 1) % 8 < 7 THEN p[i + 1] / 255 END AS r,
        CASE WHEN i > 8 THEN p[i - 8] / 255 END AS u, CASE WHEN i + 8 <= len(p) THEN p[i + 8] / 255 END AS d
      FROM px, range(1, 4097) x(i) WHERE i <= len(p)),
    m AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90,
      avg(sqrt(pow(CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END, 2)
        + pow(CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 2))) AS mean_gradient,
      avg(CAST(sqrt(pow(CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END, 2)
        + pow(CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 2)) > CAST(0.12 AS DOUBLE) AS INT)) AS edge_share
      FROM cells GROUP BY vec_id),
    s AS (SELECT c.vec_id, avg(pow((v - mean) / greatest(std, 1e-8), 3)) AS skewness, avg(pow((v - mean) / greatest(std, 1e-8), 4)) - 3 AS kurtosis
      FROM cells c JOIN m ON m.vec_id = c.vec_id GROUP BY c.vec_id),
    e AS (SELECT vec_id, sum(-share * log2(share)) AS entropy FROM (
        SELECT vec_id, floor(raw / 8) AS b, count(*) / max(n) AS share FROM cells GROUP BY 1, 2) GROUP BY vec_id)
    SELECT m.*, skewness, kurtosis, entropy FROM m JOIN s ON s.vec_id = m.vec_id JOIN e ON e.vec_id = m.vec_id""",
)
def _(t):
    from voltmill.operators.images import image_statistics

    pixel = lambda x: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * 255).cast("double"), F.lit(0.0)), F.lit(255.0))
    return image_statistics(
        t.read("embeddings").select(
            "vec_id", F.lit(8).alias("width"), F.transform("embedding", pixel).alias("pixels")
        )
    )
