"""Partitioned writes, footers and checksums of files."""

import datetime as dt
import hashlib
import os

from pyspark.sql import functions as F

from voltmill.session import new_path
from voltmill.sources import tables

START = dt.datetime(2024, 1, 1)


def test_a_hot_asset_lies_in_several_even_files(spark):
    """One asset has nine tenths of the rows, nearly all within one hour."""
    hot = spark.range(45_000).selectExpr("'hot' AS asset_id", "timestamp_seconds(1704067200 + id div 20) AS timestamp_utc", "id AS n")
    rest = spark.range(5_000).selectExpr("concat('a', id % 4) AS asset_id", "timestamp_seconds(1704067200 + id * 600) AS timestamp_utc", "id AS n")
    df = hot.unionByName(rest)
    path = new_path(spark, "skewed")
    manifest = tables.write_partitioned(df, path, rows_per_file=6_000)
    rows = manifest.withColumn("asset", F.regexp_extract("file", "asset_id=([^/]+)/", 1)).collect()
    sizes = [r.row_count for r in rows if r.asset == "hot"]
    assert sum(sizes) == 45_000 and max(sizes) <= 6_000 and len(sizes) >= 8
    assert spark.read.parquet(path).count() == 50_000
    spans = sorted((r.min_timestamp, r.max_timestamp) for r in rows if r.asset == "hot")
    assert spans[0][0] == START
    # files of an asset follow one another in time
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:], strict=False))
    checked = tables.verify_profile(spark, path, manifest, 50_000).first()
    assert checked.passed and checked.row_count == 50_000 and checked.measured_files == len(rows)


def test_footers_equal_a_scan_and_missing_statistics_are_read(spark):
    path = new_path(spark, "foot notes")
    df = spark.range(900).selectExpr("timestamp_seconds(id * 61) AS timestamp_utc", "id AS n", "id % 3 AS part")
    df = df.withColumn("timestamp_utc", F.when(F.col("part") != 2, F.col("timestamp_utc")))
    df.where("part = 0").write.mode("append").parquet(path)
    df.where("part = 2").coalesce(1).write.mode("append").parquet(path)
    known = tables.footers(tables._listed(spark, path, "*.parquet"), "timestamp_utc")
    assert known.agg(F.bool_and("complete")).first()[0]
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")  # has no statistics
    try:
        df.where("part = 1").coalesce(1).write.mode("append").parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    got = {r.file: (r.row_count, r.min_timestamp, r.max_timestamp) for r in tables.profile_files(spark, path).collect()}
    scan = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)), F.min("timestamp_utc"), F.max("timestamp_utc"))
    expected = {r[0]: tuple(r[1:]) for r in scan.collect()}
    nonempty = {file: facts for file, facts in got.items() if facts[0]}
    assert nonempty == expected and sum(facts[0] for facts in got.values()) == 900


def test_checksums_of_small_and_very_large_files(spark, tmp_path):
    """A file beyond 2 GB, which no single value can hold, is hashed in blocks."""
    (tmp_path / "small one.bin").write_bytes(b"abc")
    size = (2 << 30) + 12_345
    with open(tmp_path / "large.bin", "wb") as file:
        file.write(b"head")
        os.truncate(file.fileno(), size)  # holes take no room
    digest, block, left = hashlib.sha256(b"head"), bytes(1 << 24), size - 4
    while left:
        digest.update(block[: min(left, len(block))])
        left -= min(left, len(block))
    got = {r.file.rsplit("/", 1)[1]: (r.checksum, r.size_bytes) for r in tables.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert got == {
        "small%20one.bin": (f"sha256:{hashlib.sha256(b'abc').hexdigest()}", 3),
        "large.bin": (f"sha256:{digest.hexdigest()}", size),
    }
