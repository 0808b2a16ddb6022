"""Table reads, writes, bounded exports and profile checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmill.operators.series import place
from voltmill.schemas import AUDIT, RISKS
from voltmill.session import materialize, write_statistics


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; filters and column choices are pushed into it."""
    return spark.read.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    """Write zstd Parquet, range-clustered and sorted by ``cluster_by``."""
    write_statistics(df.sparkSession)
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_partitioned(
    df: DataFrame,
    path: str,
    key: str = "asset_id",
    ts: str = "timestamp_utc",
    rows_per_file: int = 5_000_000,
) -> DataFrame:
    """One directory per asset; returns a manifest with one row per file.

    Every asset is cut in time at splitters from measured counts, so a file
    holds about ``rows_per_file`` rows of consecutive times however unevenly
    an asset's rows lie. Small pieces are gathered into tasks of even size, and
    a piece of a single hot second is still split between tasks.
    """
    write_statistics(df.sparkSession)
    placed = place(df, [key], ts, rows_per_file)
    (
        placed.hint("rebalance", F.col(key), F.col("_bucket"))
        .sortWithinPartitions(key, ts)
        .drop("_bucket")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(key)
        .parquet(path)
    )
    return profile_files(df.sparkSession, path, ts)


#: Largest file whose content Spark's reader may hold as one value; larger ones are read in blocks.
WHOLE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
# Schemes that Arrow opens by itself.
ARROW_SCHEMES = ("file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss")


def _open(uri: str):
    """File of ``uri`` as a stream with random access."""
    scheme, _, rest = uri.partition(":")
    name = unquote("/" + rest.lstrip("/")) if scheme == "file" else unquote(uri.replace("s3a:", "s3:", 1))
    filesystem, inner = (pafs.LocalFileSystem(), name) if scheme == "file" else pafs.FileSystem.from_uri(name)
    return filesystem.open_input_file(inner)


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Files below ``path`` with their sizes; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size_bytes"))


def _arrow_opens(files: DataFrame) -> Column:
    return F.split_part("file", F.lit(":"), F.lit(1)).isin(*ARROW_SCHEMES)


def footers(files: DataFrame, ts: str) -> DataFrame:
    """Rows and time range of Parquet ``file``s from their footers; no column is read.

    ``complete`` is false where a row group with values has no statistics, so
    that the range must come from the rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                with _open(uri) as stream:
                    meta = pq.read_metadata(stream)
                at = meta.schema.names.index(ts)
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                stats = [g.column(at).statistics for g in groups]
                known = [s for s in stats if s is not None and s.has_min_max]
                empty = sum(1 for s, g in zip(stats, groups, strict=True) if s is not None and not s.has_min_max and s.has_null_count and s.null_count == g.num_rows)
                low, high = (min(s.min for s in known), max(s.max for s in known)) if known else (None, None)
                out.append((uri, meta.num_rows, low, high, len(known) + empty == len(groups)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.bool_())
            names = ["file", "row_count", "min_timestamp", "max_timestamp", "complete"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "file string, row_count bigint, min_timestamp timestamp, max_timestamp timestamp, complete boolean"
    return files.select("file").mapInArrow(read, schema)


def profile_files(spark: SparkSession, path: str, ts: str = "timestamp_utc") -> DataFrame:
    """Rows, time range and sha256 of every Parquet file below ``path``.

    Counts and ranges come from the footers. Only files without statistics, or
    on a file system that Arrow cannot open, have their column ``ts`` read.
    """
    listed = _listed(spark, path, "*.parquet")
    known = materialize(footers(listed.where(_arrow_opens(listed)).repartition("file"), ts), "footers")
    facts = known.where("complete").drop("complete")
    others = listed.join(facts, "file", "left_anti").select("file")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col(ts).alias("_ts"))
    if not others.isEmpty():
        scanned = rows.join(others, "file", "left_semi").groupBy("file").agg(
            F.count(F.lit(1)).alias("row_count"), F.min("_ts").alias("min_timestamp"), F.max("_ts").alias("max_timestamp")
        )
        facts = facts.unionByName(scanned)
    return facts.join(file_checksums(spark, path), "file", "left")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uri in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _open(uri) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            out.append(f"sha256:{digest.hexdigest()}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(1)], ["file", "checksum", "size_bytes"])


def file_checksums(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """sha256 and size of every file, computed where the file is read.

    Files above ``WHOLE_BYTES`` are fed to the hash in blocks, one file a task
    at a time, whatever their size. On a file system that Arrow cannot open,
    every file goes through Spark's own reader, which holds up to 2 GB of it.
    Spark lists no empty files.
    """
    listed = _listed(spark, path, glob)
    large = listed.where((F.col("size_bytes") > WHOLE_BYTES) & _arrow_opens(listed))
    blocks = large.repartition("file").mapInArrow(_digests, "file string, checksum string, size_bytes bigint")
    whole = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    # the filter on the length keeps the reader from opening larger files
    small = whole.where(F.col("length") <= WHOLE_BYTES).unionByName(whole.where((F.col("length") > WHOLE_BYTES) & ~_arrow_opens(whole)))
    checksum = F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum")
    return small.select("file", checksum, F.col("length").alias("size_bytes")).unionByName(blocks)


def verify_profile(
    spark: SparkSession, path: str, manifest: DataFrame, minimum_rows: int = 0
) -> DataFrame:
    """One row: measured against expected files, rows and checksums."""
    expected = manifest.select(
        "file", F.col("row_count").alias("expected_rows"), F.col("checksum").alias("expected_checksum")
    )
    measured = profile_files(spark, path)
    joined = expected.join(measured, "file", "full_outer")
    return joined.agg(
        F.count("expected_rows").alias("expected_files"),
        F.count("row_count").alias("measured_files"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(
            F.bool_and(F.coalesce(F.col("checksum") == F.col("expected_checksum"), F.lit(False))),
            F.lit(False),
        ).alias("checksums_valid"),
        F.coalesce(
            F.bool_and(F.coalesce(F.col("row_count") == F.col("expected_rows"), F.lit(False))),
            F.lit(False),
        ).alias("rows_match"),
    ).withColumn(
        "passed",
        F.col("checksums_valid") & F.col("rows_match") & (F.col("row_count") >= minimum_rows),
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit log in JSON lines, with ``log_file``, ``line`` and ``damaged``.

    ``line`` grows in the order of a file's lines. A line that is no valid event keeps its text in ``damaged``, so that
    verification reports it; blank lines and a missing file give no rows. The log is parsed once and written; its
    lines are numbered by the first row of their block, without a shuffle.
    """
    schema = T.StructType([*AUDIT.fields, T.StructField("damaged", T.StringType())])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).withColumns({"log_file": F.lit(""), "line": F.lit(0).cast("bigint")}).limit(0)
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "damaged").option("recursiveFileLookup", True).json(path)
    # rows of a block come in the order of its lines, and a line takes a byte at least
    placed = read.select("*", F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    lost = F.when(F.col("damaged").isNull() & F.col("event_id").isNull(), F.lit("no event_id")).otherwise(F.col("damaged"))
    parsed = materialize(placed.withColumn("damaged", lost), "audit-log")
    # a row for each block, written, so that the join is planned by its size
    blocks = materialize(parsed.groupBy("log_file", "_block").agg(F.min("_row").alias("_first")), "blocks")
    numbered = parsed.join(blocks, ["log_file", "_block"]).withColumn("line", F.col("_block") + F.col("_row") - F.col("_first") + 1)
    return numbered.select(*schema.names, "log_file", "line")


def read_risks(spark: SparkSession, path: str) -> DataFrame:
    """Risk register with header and integer scores."""
    return spark.read.option("header", True).option("enforceSchema", False).option("escape", "\"").schema(RISKS).csv(path)


def newest(df: DataFrame, ts: str, n: int, *tiebreak: str) -> DataFrame:
    """Newest ``n`` rows; a top-k per partition, never a global sort."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c) for c in tiebreak]).limit(n)


def export_latest(
    df: DataFrame, path: str, ts: str = "date_hour", n: int = 336, tiebreak: Sequence[str] = ("technology",)
) -> str:
    """Newest ``n`` Gold rows as one JSON document folder."""
    newest(df, ts, n, *tiebreak).coalesce(1).write.mode("overwrite").json(path)
    return path


# The columns of the fleet export.
FLEET_COLUMNS = (
    "asset_id",
    "name",
    "technology",
    "region",
    "capacity_mw",
    "current_power_mw",
    "availability",
    "mwh_at_risk",
)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> str:
    """CSV with header; without a choice the first seven columns are written."""
    chosen = list(columns) if columns else df.columns[:7]
    df.select(*chosen).write.mode("overwrite").option("header", True).csv(path)
    return path


def forecast_csv(forecast: DataFrame, technology: str, path: str) -> str:
    """Hourly P10/P50/P90 sums of one technology as CSV."""
    from voltmill.operators.marts import forecast_by_technology

    rows = forecast_by_technology(forecast).filter(F.col("technology") == technology)
    return export_csv(
        rows.withColumnRenamed("timestamp_utc", "timestamp"),
        path,
        ["timestamp", "p10_mw", "p50_mw", "p90_mw"],
    )
