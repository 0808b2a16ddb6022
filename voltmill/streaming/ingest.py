"""Streaming ingest, deduplication and Gold refresh."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltmill.operators.marts import portfolio_hourly
from voltmill.operators.silver import clean_generation
from voltmill.session import materialize


def evolved_schema(spark: SparkSession, path: str) -> StructType:
    """Union of the schemas of all landed files, for a stream (re)start.

    New columns are picked up when the stream is started again.
    """
    return spark.read.option("mergeSchema", True).parquet(path).schema


def bronze_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Landing files as a stream, with arrival time and file of origin."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path).select(
        "*",
        F.current_timestamp().alias("_ingested_at"),
        F.col("_metadata.file_path").alias("_source_file"),
    )


def append_table(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Process everything that has landed, append it to a Parquet table, stop."""
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()


def run_batches(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has landed through ``handler(batch, batch_id)``, stop."""
    (
        df.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def refresh_gold(bronze: str, gold: str, include_battery: bool = True) -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps the hourly mart equal to a full recompute.

    Bronze is kept by event date, with the batch inside each date, so a
    repeated batch replaces itself and only the days that a batch touches are
    listed and read. Every touched day is replaced in the mart, and one whose
    readings are all invalid by now is removed from it; late and repeated
    readings land in the right hour, and exact distinct counts stay possible.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumns({"event_date": F.to_date("timestamp_utc"), "batch_id": F.lit(batch_id)})
        _replace_partitions(dated, bronze, "event_date", "batch_id")
        # one row for each day of a batch
        days = [r[0] for r in spark.read.schema(dated.schema).parquet(bronze).where(F.col("batch_id") == batch_id).select("event_date").distinct().collect() if r[0]]
        rows = spark.read.schema(dated.schema).parquet(bronze).where(F.col("event_date").isin(days)).drop("event_date", "batch_id")
        mart = portfolio_hourly(clean_generation(rows), include_battery).withColumn("event_date", F.to_date("date_hour"))
        mart = materialize(mart, "mart-days")
        _replace_partitions(mart, gold, "event_date")
        for day in set(days) - {r[0] for r in mart.select("event_date").distinct().collect()}:
            _remove_folder(spark, f"{gold}/event_date={day}")

    return handle


def _replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(*keys).parquet(path)


def _remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a partition folder of a table of our own, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def merge_late(late: str, bronze: str, gold: str, include_battery: bool = True) -> Callable[[SparkSession, int], None]:
    """Merge a table of late rows (see ``split_late``) into Bronze and the mart by the hours they belong to."""
    refresh = refresh_gold(bronze, gold, include_battery)

    def merge(spark: SparkSession, run: int) -> None:
        # runs are numbered apart from the batches of the punctual side
        refresh(spark.read.parquet(late).drop("batch_id"), -1 - run)

    return merge


def dedup_stream(
    df: DataFrame,
    delay: str = "2 hours",
    keys: Sequence[str] = ("asset_id", "timestamp_utc"),
    ts: str = "timestamp_utc",
) -> DataFrame:
    """First copy of every key that arrives within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def late_rows(
    df: DataFrame, delay_seconds: int, ts: str = "timestamp_utc", arrived: str = "ingested_at"
) -> DataFrame:
    """Rows that arrived more than ``delay_seconds`` after their event time."""
    return df.filter(F.unix_micros(arrived) - F.unix_micros(ts) > delay_seconds * 1_000_000)


def split_late(main: str, late: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Batch handler that writes punctual and late rows to two tables."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        delayed = F.unix_micros("ingested_at") - F.unix_micros("timestamp_utc") > delay_seconds * 1_000_000
        marked = batch.withColumn("_late", F.coalesce(delayed, F.lit(False))).persist()
        try:
            for path, wanted in ((main, False), (late, True)):
                marked.filter(F.col("_late") == wanted).drop("_late").write.mode("overwrite").parquet(
                    f"{path}/batch_id={batch_id}"
                )
        finally:
            marked.unpersist()

    return handle


def split_behind(main: str, late: str, delay_seconds: int, ts: str = "timestamp_utc") -> Callable[[DataFrame, int], None]:
    """Batch handler that writes rows behind the watermark to ``late`` and all others to ``main``, by batch.

    The watermark of a batch is the newest event time of all batches before it
    less the delay, so no row is lost where a stateful operator with the same
    delay reads ``main``: its own watermark follows a batch later. Each batch
    leaves its mark beside ``main``, one row that already covers the batches
    before, and a repeated batch replaces its rows and its mark. ``late`` can
    be given to ``merge_late``. Rows without a time stay in ``main``.
    """
    marks = f"{main}-marks"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("newest timestamp").parquet(f"{marks}/batch_id={batch_id - 1}").first()[0] if batch_id else None
        newest = F.lit(before).cast("timestamp")
        behind = F.coalesce(F.unix_micros(ts) < F.unix_micros(newest) - delay_seconds * 1_000_000, F.lit(False))
        marked = batch.withColumn("_late", behind).persist()
        try:
            for path, wanted in ((main, False), (late, True)):
                marked.filter(F.col("_late") == wanted).drop("_late").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            mark = marked.agg(F.greatest(F.max(ts), newest).alias("newest"))
            mark.write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            marked.unpersist()

    return handle


def portfolio_hourly_stream(df: DataFrame, delay: str = "1 hour", ts: str = "timestamp_utc") -> DataFrame:
    """Hourly mart on the stream; an hour is emitted once the watermark has passed it.

    Asset counts are approximate here; ``refresh_gold`` keeps exact ones.
    """
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour"), "technology")
        .agg(
            F.sum("energy_mwh").alias("energy_mwh"),
            F.sum("power_mw").alias("actual_mw"),
            F.sum("expected_power_mw").alias("expected_mw"),
            F.avg("availability").alias("availability"),
            F.avg("price_eur_mwh").alias("price_eur_mwh"),
            F.approx_count_distinct("asset_id").alias("asset_count"),
        )
        .select(
            F.col("window.start").alias("date_hour"),
            "technology",
            "energy_mwh",
            "actual_mw",
            "expected_mw",
            "availability",
            "price_eur_mwh",
            "asset_count",
            F.greatest(F.col("expected_mw") - F.col("actual_mw"), F.lit(0.0)).alias("mwh_at_risk"),
        )
    )
