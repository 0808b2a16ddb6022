"""Queries that write given tables in a format, read them back and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.operators import forecast, governance, quality
from voltmill.plans import mart_queries
from voltmill.plans.registry import QUERIES, query
from voltmill.session import materialize, new_path
from voltmill.sources import envelopes, publish, tables


@query(
    "stored_table",
    "event_type:s n:i total:d first_id:i",
    "SELECT event_type, count(*) AS n, sum(value) AS total, min(event_id) AS first_id FROM events GROUP BY 1",
)
def _(t):
    """Events stored by type and clustered by user, read back."""
    path = tables.write_table(t.read("events"), new_path(t.spark, "stored"), ["event_type"], ["event_type", "user_id", "event_id"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first_id")
    )


@query(
    "envelope_files",
    "source_id:s extraction_date:s records:i payload_sum:i",
    """SELECT event_type AS source_id, strftime(ts, '%Y-%m-%d') AS extraction_date, count(*) AS records,
      sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS payload_sum FROM events GROUP BY 1, 2""",
)
def _(t):
    """One envelope file for each event type and day, with the events as records of its payload."""
    path = new_path(t.spark, "official")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    records = F.from_json("props", "struct<k:bigint>")
    grouped = t.read("events").groupBy(F.col("event_type").alias("source_id"), day.alias("extraction_date")).agg(F.collect_list(records).alias("records"))
    # an envelope is one document by its format; a day of one type is its bound
    text = F.to_json(F.struct("source_id", F.struct("records").alias("payload")))
    grouped.select("extraction_date", F.col("source_id").alias("run_id"), text.alias("value")).repartition("extraction_date", "run_id").write.partitionBy(
        "extraction_date", "run_id"
    ).option("compression", "none").text(path)
    read = t.spark.read.schema(envelopes.ENVELOPE_SCHEMA).option("basePath", path).json(path)
    total = F.aggregate(F.from_json("payload", "struct<records:array<struct<k:bigint>>>")["records"], F.lit(0).cast("bigint"), lambda s, r: s + r["k"])
    return read.select(
        "source_id", F.col("extraction_date").cast("string").alias("extraction_date"), envelopes.payload_record_count(F.col("payload")).alias("records"), total.alias("payload_sum")
    )


@query(
    "risk_register",
    "risk_id:s title:s likelihood:i impact:i owner:s evidence:s",
    """SELECT 'R-' || CAST(n_nationkey AS VARCHAR) AS risk_id, n_name || ', "' || r_name || '"' AS title, n_nationkey % 5 + 1 AS likelihood,
      n_regionkey + 1 AS impact, r_name AS owner, 'x.md' AS evidence FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    """A register written as CSV, with quotes and commas inside a field."""
    path = new_path(t.spark, "risks")
    rows = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.select(
        F.concat(F.lit("R-"), F.col("n_nationkey").cast("string")).alias("risk_id"),
        F.lit("Data").alias("category"),
        F.concat("n_name", F.lit(', "'), "r_name", F.lit('"')).alias("title"),
        (F.col("n_nationkey") % 5 + 1).cast("int").alias("likelihood"),
        (F.col("n_regionkey") + 1).cast("int").alias("impact"),
        *(F.lit("high").alias(c) for c in ("inherent_risk", "control", "residual_risk")),
        F.col("r_name").alias("owner"),
        F.lit("active").alias("status"),
        F.lit("x.md").alias("evidence"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_risks(t.spark, path)


@query(
    "fleet_export",
    "asset_id:s technology:s region:s",
    QUERIES["asset_rows"].sql and f"SELECT asset_id, technology, region FROM ({QUERIES['asset_rows'].sql}) AS rows",
)
def _(t):
    """The fleet table as CSV, read back."""
    path = new_path(t.spark, "fleet")
    tables.export_csv(QUERIES["asset_rows"].build(t), path, ["asset_id", "technology", "region"])
    return t.spark.read.option("header", True).csv(path)


@query(
    "forecast_export",
    "hours:i p50_sum:d",
    f"""SELECT count(*) AS hours, sum(round(p50_mw, 6)) AS p50_sum FROM ({QUERIES['forecast_by_technology'].sql}) AS f WHERE technology = 'wind'""",
)
def _(t):
    """Hourly sums of one technology as CSV, read back."""
    path = tables.forecast_csv(mart_queries.evaluation(t), "wind", new_path(t.spark, "forecast"))
    read = t.spark.read.option("header", True).option("inferSchema", True).csv(path)
    return read.agg(F.count(F.lit(1)).alias("hours"), F.sum(F.round("p50_mw", 6)).alias("p50_sum"))


@query(
    "schema_fingerprints",
    "name:s fingerprint:s",
    """SELECT * FROM (VALUES
      ('region', sha256('{"r_name": "string", "r_regionkey": "int"}')),
      ('benchmark', sha256('{"item_id": "bigint", "text": "string"}')),
      ('labels', sha256('{"doc_id": "bigint", "quality": "int", "toxic": "int"}'))) v(name, fingerprint)""",
)
def _(t):
    """Fingerprints of three given tables."""
    names = ("region", "benchmark", "labels")
    return t.spark.createDataFrame([(n, quality.schema_fingerprint(t.read(n))) for n in names], "name string, fingerprint string")


@query(
    "champion_by_value",
    "user_id:i event_type:s rank:i alias:s",
    """WITH s AS (SELECT user_id, event_type, avg(value) AS score FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rank FROM s)
    SELECT user_id, event_type, rank, CASE rank WHEN 1 THEN 'Champion' WHEN 2 THEN 'Challenger' END AS alias FROM r""",
)
def _(t):
    """Candidates ranked by the larger score, as for classifiers."""
    scores = t.read("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    ranked = forecast.rank_models(scores, ["user_id"], ["score"], descending=True, name="event_type")
    return ranked.withColumnRenamed("selection_rank", "rank")


PUBLISHED = ("market_hourly", "energy_mix", "asset_rows", "top_incidents", "quality_scorecard", "capture_rates")


@query(
    "published_documents",
    "document:s outcome:s rows:i",
    " UNION ALL ".join(f"SELECT '{n}' AS document, 'match' AS outcome, (SELECT count(*) FROM ({QUERIES[n].sql}) AS q) AS rows" for n in PUBLISHED),
)
def _(t):
    """Six documents published, their files held against the manifest, and their rows read back."""
    path = new_path(t.spark, "public")
    files = publish.publish({n: QUERIES[n].build(t) for n in PUBLISHED}, path, "2024-01-31", check=False)
    document = F.regexp_extract("file", r"/latest/([^/]+)/", 1)
    outcomes = governance.verify_manifests(t.spark, f"{path}/latest", files, "*.json")
    worst = outcomes.groupBy(document.alias("document")).agg(F.max(F.when(F.col("outcome") != "match", F.col("outcome"))).alias("_worst"))
    lines = t.spark.read.option("recursiveFileLookup", True).text(f"{path}/latest").select(F.regexp_extract("_metadata.file_path", r"/latest/([^/]+)/", 1).alias("document"))
    rows = materialize(lines.groupBy("document").agg(F.count(F.lit(1)).alias("rows")), "published")
    return worst.join(rows, "document").select("document", F.coalesce("_worst", F.lit("match")).alias("outcome"), "rows")
