"""Session settings, shared storage and small DataFrame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMESTAMP_TYPE = "spark.sql.parquet.outputTimestampType"
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "voltmill", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every operator here relies on.

    The cluster decides executors, memory and shuffle width; only semantics
    (UTC) and adaptive execution are set by default.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        TIMESTAMP_TYPE: "TIMESTAMP_MICROS",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone; every timestamp operator assumes UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def write_statistics(spark: SparkSession) -> SparkSession:
    """Write times as 64-bit numbers: the older 96-bit form has no statistics, so no filter could skip by it."""
    spark.conf.set(TIMESTAMP_TYPE, "TIMESTAMP_MICROS")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to all executors, named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode with the setting unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="voltmill-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later jobs need the same rows: the written table cuts
    the lineage and survives the loss of executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def epoch_bucket(ts: Column | str, seconds: int) -> Column:
    """Index of the fixed-width time bucket that holds ``ts``."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(column) / F.lit(seconds)).cast("long")
