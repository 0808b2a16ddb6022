"""Two-pass external shuffle into shards.

Pass 1 scatters records uniformly into buckets that fit in memory, by a seeded hash of the id. Pass 2 shuffles each
bucket by Fisher-Yates and writes it. The buckets in order are one random order of all records; shards are its equal
runs, so a bucket is written to one or two shards and no record is moved a second time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmill.session import new_path

SHARDS = 24
SEED = 20
#: Bytes of text in a bucket, unless one cell holds more.
BUCKET_BYTES = 16 << 20
#: Hash cells, which are put together to buckets. Their counts are all that the driver sees.
CELLS = 1 << 16


def _cells(records: DataFrame, id_column: str, text_column: str, seed: int, cells: int) -> DataFrame:
    """``record``, its ``cell`` and its ``size``; a null id is scattered by the text."""
    record = F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record")
    text = F.col(text_column).cast("string")
    key = F.xxhash64(F.lit(seed), F.col(id_column), F.when(F.col(id_column).isNull(), text))
    return records.select(
        record, F.pmod(key, F.lit(cells)).cast("int").alias("cell"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size")
    )


def shuffle_into_shards(
    records: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    cells: int = CELLS,
    path: str | None = None,
) -> DataFrame:
    """Write all records in a random order to ``path``, one folder for each shard, and read them back.

    Columns: ``record`` (all columns of the input as a struct, so no name can clash), ``shard`` (0 to ``shards`` - 1)
    and ``slot`` (place in the shard, gapless from 0; the rows of a file follow it). Row counts of shards differ by at
    most one. The same records, seed and sizes give the same order, however the input is partitioned; rows that agree in
    id and text are interchangeable. Null ids and texts, repeated rows and empty tables are allowed.
    """
    spark = records.sparkSession
    scattered = _cells(records, id_column, text_column, seed, cells)
    counts = scattered.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).orderBy("cell").collect()
    buckets, room, before = [], 0, 0
    for r in counts:
        if not buckets or room + r["bytes"] > bucket_bytes:
            buckets.append([len(buckets), before])
            room = 0
        room += r["bytes"]
        before += r["rows"]
        buckets[-1].append(r["cell"])
    total = before
    assigned = spark.createDataFrame(
        [(cell, b[0], b[1]) for b in buckets for cell in b[2:]], "cell int, bucket int, first bigint"
    )
    schema = T.StructType([scattered.schema["record"], T.StructField("position", T.LongType())])

    def fisher_yates(table: pa.Table) -> pa.Table:
        bucket, first = table.column("bucket")[0].as_py(), table.column("first")[0].as_py()
        table = table.sort_by([("key", "ascending"), ("crc", "ascending")])
        order = np.random.default_rng([seed, bucket]).permutation(table.num_rows)
        return pa.table({"record": table.column("record").take(pa.array(order)), "position": pa.array(np.arange(first, first + len(order)))})

    placed = (
        scattered.join(F.broadcast(assigned), "cell")
        .withColumn("key", F.col(f"record.`{id_column}`").cast("string"))
        .withColumn("crc", F.crc32(F.coalesce(F.col(f"record.`{text_column}`").cast("string"), F.lit("")).cast("binary")))
        .drop("cell", "size")
        .groupBy("bucket")
        .applyInArrow(fisher_yates, schema)
    )
    shard = F.expr(f"cast(position * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"cast((shard * {max(total, 1)}L + {shards - 1}) div {shards} as bigint)")
    out = path or new_path(spark, "shards")
    (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("position") - start)
        .drop("position")
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(out)
    )
    return spark.read.schema(T.StructType([scattered.schema["record"], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(out)
