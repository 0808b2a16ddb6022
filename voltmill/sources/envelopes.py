"""Official-source envelopes: reading, counting and flattening their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_SCHEMA = (
    "source_id string, requested_url string, status_code int, extracted_at string,"
    " source_updated_at string, payload_checksum_sha256 string, schema_fingerprint_sha256 string,"
    " request_id string, response_headers map<string,string>, attribution string,"
    " license_notes string, payload string"
)
COUNT_SCHEMA = (
    "struct<value:map<string,string>,outputs:struct<monthly:array<string>>,"
    "included:array<struct<attributes:struct<values:array<string>>>>,records:array<string>>"
)
MIX_SCHEMA = (
    "struct<included:array<struct<id:string,type:string,attributes:struct<title:string,type:string,"
    "values:array<struct<value:double,percentage:double,datetime:string>>>>>>"
)
CUBE_SCHEMA = (
    "struct<value:map<string,double>,id:array<string>,size:array<int>,"
    "dimension:map<string,struct<category:struct<index:map<string,int>>>>>"
)


def read_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Envelope documents below ``root``; the payload stays JSON text.

    ``extraction_date`` and ``run_id`` come from the folder names, so a filter
    on them skips whole folders.
    """
    return (
        spark.read.schema(ENVELOPE_SCHEMA)
        .option("multiLine", True)
        .option("basePath", root)
        .option("pathGlobFilter", "*.json")
        .json(root)
    )


def payload_record_count(payload: Column) -> Column:
    """Records in a payload, by the first structure that is present."""
    parsed = F.from_json(payload, COUNT_SCHEMA)
    in_series = F.aggregate(
        F.transform(
            parsed["included"], lambda item: F.coalesce(F.size(item["attributes"]["values"]), F.lit(0))
        ),
        F.lit(0),
        lambda total, n: total + F.greatest(n, F.lit(0)),
    )
    return (
        F.when(parsed["value"].isNotNull(), F.size(parsed["value"]))
        .when(parsed["outputs"]["monthly"].isNotNull(), F.size(parsed["outputs"]["monthly"]))
        .when(parsed["included"].isNotNull(), in_series)
        .when(parsed["records"].isNotNull(), F.size(parsed["records"]))
        .otherwise(1)
        .cast("long")
    )


def flatten_generation_mix(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per series and time of a generation-mix payload, times in UTC."""
    series = F.explode(F.from_json(payload, MIX_SCHEMA)["included"])
    points = df.select(*keep, series.alias("_s")).select(
        *keep,
        F.coalesce("_s.attributes.title", "_s.type").alias("series"),
        F.col("_s.attributes.type").alias("type"),
        F.explode("_s.attributes.values").alias("_v"),
    )
    return points.select(
        *keep,
        "series",
        "type",
        F.to_timestamp("_v.datetime").alias("datetime_utc"),
        F.col("_v.value").alias("value"),
        F.col("_v.percentage").alias("percentage"),
    )


def decode_jsonstat(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per cube cell with its coordinates as a map dimension -> category.

    A cell's flat index is split by the strides of the dimensions: the stride
    of a dimension is the product of the sizes after it.
    """
    cube = df.select(*keep, F.from_json(payload, CUBE_SCHEMA).alias("_c"))
    cells = cube.select(*keep, "_c", F.explode("_c.value").alias("_flat", "value")).withColumn(
        "_flat", F.col("_flat").cast("long")
    )
    place = F.expr(
        """transform(_c.id, (d, i) -> CAST(
             (_flat div aggregate(slice(_c.size, i + 2, size(_c.size)), 1L, (a, s) -> a * s)) % get(_c.size, i) AS INT))"""
    )
    names = F.expr(
        """transform(_c.id, (d, i) -> element_at(map_keys(map_filter(
             try_element_at(_c.dimension, d).category.index, (k, v) -> v = get(_places, i))), 1))"""
    )
    return (
        cells.withColumn("_places", place)
        .withColumn("_names", names)
        .select(
            *keep,
            F.col("_flat").alias("cell"),
            F.map_from_arrays("_c.id", "_names").alias("coordinates"),
            "value",
        )
    )


def payload_checksum_rows(envelopes: DataFrame) -> DataFrame:
    """Observed state per source in the shape of the source table."""
    return envelopes.groupBy("source_id").agg(
        F.max_by(
            F.struct(
                F.when(F.col("status_code") == 200, "success").otherwise("failed").alias("status"),
                payload_record_count(F.col("payload")).alias("records"),
                F.col("payload_checksum_sha256").alias("checksum"),
                F.col("extracted_at").alias("extracted_at"),
            ),
            "extracted_at",
        ).alias("_r")
    ).select("source_id", "_r.*")
