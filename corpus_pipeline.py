"""Corpus pipeline: toxic and poor documents go, one of each group of near copies stays, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.llm import jaccard, packing, quality, toxicity
from voltmill.session import materialize

#: The toxicity model is fitted here, so no SQL gives the same rows; tests hold the stages against brute force.
ORACLE_SQL = None


#: Name of the key while a stage runs.
ROW = "_pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, which orders them by id, rows without an id last.

    The key holds the row's file (by a hash of its path) and place there, so every scan of a written table gives the
    same; any other frame is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = materialize(docs, "stage-input")
    file = F.xxhash64("_metadata.file_path")
    return docs.withColumn(ROW, F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), file.alias("file"), F.col("_metadata.row_index").alias("place")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the field scores below one half."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, the one with the smallest id; rows without an id count like others.

    The keys of the rows that go are written first, so that the join with the texts is planned by their size.
    """
    keyed = _keyed(docs)
    found = jaccard.jaccard_components(keyed, ROW)
    gone = materialize(found.where(F.col("component_id") != F.col(ROW)).select(F.col(ROW).alias("gone_row")), "copies")
    return keyed.join(gone, F.col(ROW) == F.col("gone_row"), "left_anti").drop(ROW)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
