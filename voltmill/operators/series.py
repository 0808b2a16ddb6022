"""Exact per-series windows that stay parallel when one series is huge.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. The
helpers here split each series into bounded pieces instead:

* ``place`` cuts every series into time buckets of about equal numbers of rows,
  at splitters found from measured counts, however unevenly its rows lie;
* ``number_rows`` gives every row its position in its series, using one window
  per (series, time bucket) plus a running total over the bucket counts;
* ``with_halo`` cuts a numbered series into chunks of ``chunk_rows`` and copies
  the last ``halo_rows`` rows of a chunk into the next one, so row lags and
  row frames up to that length are exact inside a chunk;
* ``with_time_halo`` does the same for frames measured in time;
* ``carry_bounds`` finds, per bucket, the nearest wanted value in all earlier
  and all later buckets, however far away they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.session import epoch_bucket, materialize

HOUR = 3_600
CHUNK_ROWS = 100_000


def splitters(df: DataFrame, keys: Sequence[str], ts: str, rows: int = CHUNK_ROWS, cell_seconds: int = HOUR, refine: bool = True) -> DataFrame:
    """``keys`` and ``_starts``: the ascending seconds at which a bucket of a series begins, the first one left out.

    Rows are counted per series and cell of time, which is small beside the rows. Running totals of a series say where
    a bucket is full: a bucket begins with the cell that holds the next multiple of ``rows``, so no bucket has more than
    ``rows`` and one cell. With ``refine`` a cell of more than ``rows`` is counted again by seconds.
    """
    keys = list(keys)
    second = F.unix_seconds(F.col(ts))
    start = (F.floor(second / cell_seconds) * cell_seconds).cast("long")
    # written, so that the joins with rows are planned by its size
    cells = materialize(df.groupBy(*keys, start.alias("_start")).agg(F.count(F.lit(1)).alias("_n")), "cells")
    if refine and (cells.agg(F.max("_n")).first()[0] or 0) > rows:
        heavy = cells.filter(F.col("_n") > rows).select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.col("_start").alias("_cell"))
        same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        dense = df.withColumn("_of", start).join(heavy, [*same, F.col("_of") == F.col("_cell")])
        fine = dense.groupBy(*keys, second.alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
        cells = materialize(cells.filter(F.col("_n") <= rows).unionByName(fine), "cells")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    full = cells.withColumn("_full", F.floor(F.coalesce(before, F.lit(0)) / rows)).groupBy(*keys, "_full").agg(F.min("_start").alias("_start"))
    later = F.when(F.col("_full") > 0, F.col("_start"))
    return full.groupBy(*keys).agg(F.sort_array(F.collect_list(later)).alias("_starts"))


def _bucket_of(second: Column) -> Column:
    """Number of ``_starts`` at or before ``second``, by halving steps."""
    size = F.size("_starts")
    steps = F.transform(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= size) & (F.get("_starts", at + step - 1) <= second), at + step).otherwise(at),
    )
    return F.when(second.isNotNull(), F.when(size > 0, found).otherwise(F.lit(0))).cast("long")


def place(df: DataFrame, keys: Sequence[str], ts: str, rows: int = CHUNK_ROWS, cuts: DataFrame | None = None) -> DataFrame:
    """Add ``_bucket``, which grows with ``ts`` and holds about ``rows`` rows of a series; see :func:`splitters`."""
    keys = list(keys)
    cuts = splitters(df, keys, ts, rows) if cuts is None else cuts
    named = cuts.select(*(F.col(k).alias(f"_s_{k}") for k in keys), "_starts")
    joined = df.join(named, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return joined.withColumn("_bucket", _bucket_of(F.unix_seconds(F.col(ts)))).drop("_starts", *(f"_s_{k}" for k in keys))


def bucketed_rows(df: DataFrame, keys: Sequence[str], ts: str, bucket_seconds: int | None = None) -> DataFrame:
    """Add ``_bucket``: of ``bucket_seconds`` each, or of about ``CHUNK_ROWS`` rows."""
    return place(df, keys, ts, CHUNK_ROWS) if bucket_seconds is None else df.withColumn("_bucket", epoch_bucket(ts, bucket_seconds))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tiebreak: Sequence[str] = (),
    bucket_seconds: int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``_bucket`` and the zero-based series position ``_pos``.

    Buckets hold about ``CHUNK_ROWS`` rows each, unless ``bucket_seconds``
    fixes their length or ``bucket`` is given, a column that grows with any
    ordered column ``ts``. Two shuffles: the rows by (series, bucket),
    and the bucket counts, which are one row per series and bucket.
    """
    keys = list(keys)
    bucketed = bucketed_rows(df, keys, ts, bucket_seconds) if bucket is None else df.withColumn("_bucket", bucket)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys)
                    .orderBy("_bucket")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tiebreak)
    return (
        bucketed.withColumn("_rn", F.row_number().over(in_bucket))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("_pos", F.col("_offset") + F.col("_rn") - 1)
        .drop("_rn", "_offset")
    )


def with_halo(
    numbered: DataFrame, halo_rows: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; halo rows are copies from the chunk before."""
    chunk_rows = max(chunk_rows, halo_rows)
    own = F.floor(F.col("_pos") / chunk_rows).cast("long")
    near_end = F.col("_pos") % chunk_rows >= chunk_rows - halo_rows
    return (
        numbered.withColumn("_own", own)
        .withColumn(
            "_chunk",
            F.explode(
                F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
            ),
        )
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_own")
    )


def with_time_halo(
    df: DataFrame, ts: str, halo_seconds: int, bucket_seconds: int | None = None, keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_epoch``, ``_chunk`` and ``_halo`` for frames measured in seconds.

    Chunks hold about ``chunk_rows`` rows of a series, or are ``bucket_seconds``
    long. They are never shorter than the halo, so a row is copied once at most.
    """
    second = F.unix_seconds(F.col(ts))
    if bucket_seconds is None:
        cuts = splitters(df, keys, ts, chunk_rows, halo_seconds, refine=False)
        named = cuts.select(*(F.col(k).alias(f"_s_{k}") for k in keys), "_starts")
        joined = df.join(named, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]).drop(*(f"_s_{k}" for k in keys))
        both = joined.withColumns({"_own": _bucket_of(second), "_next": _bucket_of(second + halo_seconds)}).drop("_starts")
    else:
        length = max(bucket_seconds, halo_seconds)
        chunk = lambda at: F.floor(at / length).cast("long")
        both = df.withColumns({"_own": chunk(second), "_next": chunk(second + halo_seconds)})
    return (
        both.withColumn("_epoch", second)
        .withColumn("_chunk", F.explode(F.array_distinct(F.array("_own", "_next"))))
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_own", "_next")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    """Remove halo copies and helper columns."""
    helpers = [c for c in ("_bucket", "_pos", "_chunk", "_halo", "_epoch") if c in df.columns]
    return df.filter(~F.col("_halo")).drop(*helpers)


def carry_bounds(
    df: DataFrame, keys: Sequence[str], order: str, wanted: dict[str, Column]
) -> DataFrame:
    """Per (series, bucket): nearest wanted struct before and after the bucket.

    ``wanted`` maps a name to a struct column that is NULL where the row has
    nothing to offer. The result has ``<name>_before`` and ``<name>_after`` and
    one row per series and bucket.
    """
    keys = list(keys)
    aggregates = []
    for name, column in wanted.items():
        aggregates.append(F.max_by(column, F.when(column.isNotNull(), F.col(order))).alias(f"_l_{name}"))
        aggregates.append(F.min_by(column, F.when(column.isNotNull(), F.col(order))).alias(f"_f_{name}"))
    summary = df.groupBy(*keys, "_bucket").agg(*aggregates)
    # a frame to the end of the partition is recomputed per row, so "after"
    # runs backwards from the other end instead
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    columns = [*keys, "_bucket"]
    for name in wanted:
        columns.append(F.last(f"_l_{name}", ignorenulls=True).over(before).alias(f"{name}_before"))
        columns.append(F.last(f"_f_{name}", ignorenulls=True).over(after).alias(f"{name}_after"))
    return summary.select(*columns)


def lag_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: dict[str, tuple[str, int]],
    tiebreak: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Exact row lags: ``columns`` maps a new name to (source column, rows back)."""
    halo = max(rows for _, rows in columns.values())
    chunks = with_halo(number_rows(df, keys, ts, tiebreak), halo, chunk_rows)
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    for name, (source, rows) in columns.items():
        chunks = chunks.withColumn(name, F.lag(source, rows).over(frame))
    return drop_halo(chunks)
