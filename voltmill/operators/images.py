"""Intensity and gradient statistics of gray images held as pixel arrays.

An image is one row with ``width`` and a row-major array of values in 0..255.
Every statistic is a column expression, so images run in parallel like any
other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Histogram bins, gradient threshold and quantiles.
HISTOGRAM_BINS = 32
EDGE_THRESHOLD = 0.12
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (file, width, height, pixels, rejection); colours become luminance.

    A file that cannot be decoded has a rejection and no pixels.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    able = F.col("width") > 0
    count = F.col("width") * F.col("height")
    byte = lambda at: F.conv(F.hex(F.substring(F.col("data"), at, F.lit(1))), 16, 10).cast("double")
    # bytes are stored blue, green, red
    colour = lambda i: (
        0.114 * byte(i * F.col("nChannels") + 1)
        + 0.587 * byte(i * F.col("nChannels") + 2)
        + 0.299 * byte(i * F.col("nChannels") + 3)
    )
    gray = lambda i: F.when(F.col("nChannels") == 1, byte(i + 1)).otherwise(colour(i))
    return raw.select(
        F.col("origin").alias("file"),
        F.when(able, F.col("width")).alias("width"),
        F.when(able, F.col("height")).alias("height"),
        F.when(able, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), gray)).alias("pixels"),
        F.when(~F.coalesce(able, F.lit(False)), F.lit("UNDECODABLE")).alias("rejection"),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _slope(before: Column, here: Column, after: Column) -> Column:
    """Central difference, one-sided where a neighbour is missing."""
    return (
        F.when(before.isNull() & after.isNull(), F.lit(0.0))
        .when(before.isNull(), after - here)
        .when(after.isNull(), here - before)
        .otherwise((after - before) / 2)
    )


def image_statistics(df: DataFrame, pixels: str = "pixels", width: str = "width") -> DataFrame:
    """Add mean, deviation, quantiles, entropy, skewness, kurtosis and gradients."""
    scaled = df.withColumn("_v", F.transform(pixels, lambda p: p.cast("double") / 255.0))
    w, v = F.col(width).cast("int"), F.col("_v")
    size = F.size("_v")

    def gradient(value: Column, i: Column) -> Column:
        column = i % w
        left = F.when(column > 0, F.get(v, i - 1))
        right = F.when(column < w - 1, F.get(v, i + 1))
        above = F.when(i >= w, F.get(v, i - w))
        below = F.when(i + w < size, F.get(v, i + w))
        return F.hypot(_slope(left, value, right), _slope(above, value, below))

    def bin_entropy(index: Column) -> Column:
        step = 256 // HISTOGRAM_BINS
        hits = F.size(F.filter(F.col(pixels), lambda p: F.floor(p / step) == index))
        share = hits / size
        return F.when(hits > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    def quantile(prob: float) -> Column:
        rank = (size - 1) * F.lit(prob)
        low = F.get(F.col("_sorted"), F.floor(rank).cast("int"))
        high = F.get(F.col("_sorted"), F.ceil(rank).cast("int"))
        return low + (high - low) * (rank - F.floor(rank))

    moment = lambda power: _mean(F.transform("_v", lambda x: F.pow((x - F.col("mean")) / F.col("_scale"), F.lit(power))))
    return (
        scaled.withColumn("mean", _mean(v))
        .withColumn("std", F.sqrt(_mean(F.transform("_v", lambda x: F.pow(x - F.col("mean"), F.lit(2.0))))))
        .withColumns(
            {
                "_scale": F.greatest("std", F.lit(1e-8)),
                "_sorted": F.sort_array("_v"),
                "_gradient": F.transform("_v", gradient),
            }
        )
        .withColumns(
            {
                **{name: quantile(prob) for name, prob in QUANTILES.items()},
                "entropy": F.aggregate(
                    F.transform(F.sequence(F.lit(0), F.lit(HISTOGRAM_BINS - 1)), bin_entropy),
                    F.lit(0.0),
                    lambda total, x: total + x,
                ),
                "skewness": moment(3.0),
                "kurtosis": moment(4.0) - 3,
                "edge_share": F.size(F.filter("_gradient", lambda g: g > EDGE_THRESHOLD)) / size,
                "mean_gradient": _mean(F.col("_gradient")),
                "contrast": F.col("std") * 255,
            }
        )
        .drop("_v", "_scale", "_sorted", "_gradient")
    )
