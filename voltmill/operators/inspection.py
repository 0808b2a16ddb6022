"""Classification evaluation, splits, triage and reviews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.operators.quantiles import exact_quantiles, score_totals

# Triage thresholds.
HIGH_CONFIDENCE = 0.85
REVIEW_CONFIDENCE = 0.8
MINIMUM_CONTRAST = 5.0
REVIEW_ACTIONS = ("approve", "reject", "correct")


def confusion_matrix(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (truth, predicted)."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    by = list(by)
    pairs = confusion_matrix(df, truth, predicted, by)
    roles = pairs.select(
        *by,
        "n",
        (F.col("truth") == F.col("predicted")).alias("_hit"),
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.lit(True).alias("_is_truth")),
                F.struct(F.col("predicted").alias("label"), F.lit(False).alias("_is_truth")),
            )
        ).alias("_r"),
    )
    totals = roles.groupBy(*by, F.col("_r.label").alias("label")).agg(
        F.sum(F.when(F.col("_r._is_truth"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("_r._is_truth"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("_r._is_truth") & F.col("_hit"), F.col("n")).otherwise(0)).alias("hits"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return totals.select(
        *by,
        "label",
        zero(F.try_divide("hits", "predicted")).alias("precision"),
        zero(F.try_divide("hits", "support")).alias("recall"),
        zero(F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("support"))).alias("f1"),
        "support",
        "hits",
    )


def classification_summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from the class rows."""
    return report.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("n"),
    )


def calibration_error(
    df: DataFrame, truth: str, predicted: str, confidence: str, bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Expected calibration error over bins closed on the right."""
    by = list(by)
    edges = [k / bins for k in range(bins + 1)]
    chosen = reduce(
        lambda rest, k: F.when(
            (F.col(confidence) > edges[k]) & (F.col(confidence) <= edges[k + 1]), k
        ).otherwise(rest),
        range(bins),
        F.lit(None),
    )
    per_bin = (
        df.withColumn("_bin", chosen)
        .groupBy(*by, "_bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"),
            F.avg(confidence).alias("confidence"),
        )
    )
    gap = F.when(
        F.col("_bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    ).otherwise(0.0)
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("expected_calibration_error"))


def brier(df: DataFrame, truth: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of a 0/1 truth against its probability.

    For many classes pass the long form (one row per item and class).
    """
    return df.groupBy(*by).agg(
        F.avg(F.pow(F.col(truth).cast("double") - F.col(probability), 2.0)).alias("brier_score")
    )


def ranking_scores(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision per group, ties counted half.

    ``truth`` is 0/1 and ``score`` lies in [0, 1]. Equal scores are combined
    first, and the running totals work per score bin, so a large group is
    spread over many tasks.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    marked = rows.select(
        *keys,
        F.col(score).cast("double").alias("score"),
        F.col(truth).cast("long").alias("pos"),
        (1 - F.col(truth).cast("long")).alias("neg"),
    )
    running = score_totals(marked, keys, "score", ["pos", "neg"])
    scored = running.groupBy(*keys).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2)).alias("_wins"),
        F.sum(
            F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
        ).alias("_precision"),
    )
    return scored.select(
        *by,
        F.try_divide(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_precision"), F.col("_p")).alias("average_precision"),
        F.col("_p").alias("positives"),
        F.col("_n").alias("negatives"),
    )


def macro_ranking(long_scores: DataFrame, label: str = "label") -> DataFrame:
    """Unweighted mean over the one-vs-rest scores of all classes."""
    return ranking_scores(long_scores, "truth", "score", [label]).agg(
        F.avg("roc_auc").alias("roc_auc"), F.avg("average_precision").alias("average_precision")
    )


def hash_unit(columns: Sequence[str], seed: int) -> Column:
    """Reproducible number in [0, 1) from key columns and a seed."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def split(
    df: DataFrame,
    key: Sequence[str],
    strata: Sequence[str] = (),
    group: Sequence[str] = (),
    test: float = 0.2,
    validation: float = 0.16,
    seed: int = 42,
) -> DataFrame:
    """Train, validation and test parts by the order of a key hash.

    With ``strata`` every stratum (a small vocabulary) is cut at its own exact
    hash quantiles, so the shares hold per stratum. With ``group`` all rows of
    a group share a part: the cuts are taken over the distinct groups.
    """
    unit = hash_unit(list(group) or list(key), seed)
    rows = df.withColumn("_u", unit)
    base = rows.select(*group, "_u").distinct() if group else rows
    by = [] if group else list(strata)
    cuts = exact_quantiles(base, by, "_u", [test, test + validation], bounded_groups=True)
    pivoted = cuts.groupBy(*by).agg(
        F.min("quantile").alias("_test"), F.max("quantile").alias("_validation")
    )
    if by:
        rows = rows.join(pivoted, by)
    else:
        rows = rows.withColumn("_test", pivoted.select("_test").scalar()).withColumn(
            "_validation", pivoted.select("_validation").scalar()
        )
    part = (
        F.when(F.col("_u") <= F.col("_test"), "test")
        .when(F.col("_u") <= F.col("_validation"), "validation")
        .otherwise("train")
    )
    return rows.withColumn("part", part).drop("_u", "_test", "_validation")


def triage(df: DataFrame) -> DataFrame:
    """Severity and review need of inspected images.

    Expects ``prediction``, ``confidence`` and ``contrast``; an image without
    enough contrast is not judged and goes to review.
    """
    low_contrast = F.coalesce(F.col("contrast") < MINIMUM_CONTRAST, F.lit(False))
    prediction = F.when(~low_contrast, F.col("prediction"))
    confidence = F.when(~low_contrast, F.col("confidence"))
    defective = F.coalesce(prediction == "defective", F.lit(False))
    return df.withColumns(
        {
            "status": F.when(low_contrast, "review_required").otherwise("completed"),
            "quality_score": F.when(low_contrast, F.bround(F.col("contrast") / MINIMUM_CONTRAST, 3)),
            "severity": F.when(defective & (confidence >= HIGH_CONFIDENCE), "high")
            .when(defective, "medium")
            .otherwise("low"),
            "review_required": low_contrast
            | defective
            | F.coalesce(confidence < REVIEW_CONFIDENCE, F.lit(False)),
        }
    )


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews with the reason they are refused, NULL when acceptable."""
    return reviews.withColumn(
        "rejection",
        F.when(
            ~F.col("inspection_id").startswith("VIS-") | (F.length("inspection_id") > 64),
            "invalid inspection_id",
        )
        .when(~F.col("action").isin(*REVIEW_ACTIONS), "unknown action")
        .when(
            (F.col("action") == "correct") & F.col("corrected_label").isNull(),
            "corrected_label is required",
        ),
    )


def apply_reviews(inspections: DataFrame, reviews: DataFrame, ts: str = "reviewed_at") -> DataFrame:
    """Inspections with the newest accepted review applied."""
    accepted = review_violations(reviews).filter(F.col("rejection").isNull())
    latest = accepted.groupBy("inspection_id").agg(
        F.max_by(F.struct("action", "corrected_label", "reviewer"), F.struct(ts, "review_id")).alias("_r")
    )
    return inspections.join(latest, "inspection_id", "left").select(
        *inspections.columns,
        F.coalesce("_r.action", F.lit("pending")).alias("review_status"),
        F.when(F.col("_r.action") == "correct", F.col("_r.corrected_label"))
        .otherwise(F.col("label"))
        .alias("final_label"),
    )
