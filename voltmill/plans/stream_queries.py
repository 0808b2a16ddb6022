"""Streaming queries over the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltmill.plans.mart_queries import GOLD_SPEC, GOLD_SQL
from voltmill.plans.registry import query
from voltmill.plans.telemetry import TELEMETRY_SQL, telemetry_from_events
from voltmill.session import materialize, new_path
from voltmill.streaming import ingest, monitors


def landed(t, files: int = 4):
    """The event table as landing files, spread so that batches overlap in time."""
    path = new_path(t.spark, "landing")
    t.read("events").repartition(files, "event_id").write.parquet(path)
    return path, t.read("events").schema


def telemetry_stream(t, max_files: int | None = 1):
    path, schema = landed(t)
    return telemetry_from_events(ingest.bronze_stream(t.spark, path, schema, max_files))


@query(
    "bronze_stream",
    "event_type:s n:i files:b",
    "SELECT event_type, count(*) AS n, TRUE AS files FROM events GROUP BY event_type",
)
def _(t):
    path, schema = landed(t)
    out = new_path(t.spark, "bronze")
    ingest.append_table(
        ingest.bronze_stream(t.spark, path, schema, 1), out, new_path(t.spark, "checkpoint")
    )
    return t.spark.read.parquet(out).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("_source_file").isNotNull() & F.col("_ingested_at").isNotNull()).alias("files"),
    )


@query("stream_gold", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold")
def _(t):
    gold = new_path(t.spark, "gold")
    handler = ingest.refresh_gold(new_path(t.spark, "bronze"), gold)
    ingest.run_batches(telemetry_stream(t), handler, new_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(gold)


@query("stream_gold_correction", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold WHERE extract(day FROM date_hour) <> 10")
def _(t):
    """A second batch finds every reading of the tenth day out of range; the mart loses that day."""
    path = new_path(t.spark, "landing")
    wrong = t.telemetry.where(F.dayofmonth("timestamp_utc") == 10).withColumns(
        {"power_mw": F.lit(-5.0), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 DAY"), "technology": F.lit("wind")}
    )
    gold = new_path(t.spark, "gold")
    handler = ingest.refresh_gold(new_path(t.spark, "bronze"), gold)
    for rows in (t.telemetry, wrong):
        rows.coalesce(4).write.mode("append").parquet(path)
        stream = ingest.bronze_stream(t.spark, path, t.telemetry.schema).drop("_ingested_at", "_source_file")
        ingest.run_batches(stream, handler, f"{gold}-checkpoint")
    return t.spark.read.parquet(gold)


@query("stream_late_merge", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold")
def _(t):
    """Punctual rows make the mart first; late ones are merged into their hours afterwards."""
    main, late, bronze, gold = (new_path(t.spark, x) for x in ("main", "late", "bronze", "gold"))
    ingest.run_batches(telemetry_stream(t), ingest.split_late(main, late, 45 * 60), new_path(t.spark, "checkpoint"))
    refresh = ingest.refresh_gold(bronze, gold)
    refresh(t.spark.read.parquet(main).drop("batch_id"), 0)
    ingest.merge_late(late, bronze, gold)(t.spark, 0)
    return t.spark.read.parquet(gold)


#: Landing of a reading: one for five days, and three landings later for some readings of the first three.
LANDING_SQL = f"""{TELEMETRY_SQL}, periods AS (
  SELECT *, least(greatest(date_diff('day', TIMESTAMP '2024-01-01', timestamp_utc) // 5, 0), 5) AS period FROM telemetry
), landings AS (SELECT *, period < 3 AND event_sequence % 50 = 0 AS behind FROM periods)"""


def landed_in_time(t):
    """Readings as six landing files in the order of time, with some readings far behind; a stream of one file a batch."""
    path = new_path(t.spark, "landing")
    day = F.datediff("timestamp_utc", F.lit("2024-01-01").cast("date"))
    period = F.least(F.greatest(F.floor(day / 5), F.lit(0)), F.lit(5))
    behind = (period < 3) & (F.col("event_sequence") % 50 == 0)
    placed = materialize(t.telemetry.withColumn("_landing", F.when(behind, period + 3).otherwise(period)), "landings")
    for k in range(6):
        placed.where(F.col("_landing") == k).drop("_landing").coalesce(1).write.mode("append").parquet(path)
    return ingest.bronze_stream(t.spark, path, t.telemetry.schema, 1).drop("_ingested_at", "_source_file")


@query(
    "stream_hourly",
    "date_hour:t technology:s energy_mwh:d actual_mw:d expected_mw:d asset_count:i",
    f"""WITH {LANDING_SQL} SELECT timestamp_utc AS date_hour, technology, sum(energy_mwh) AS energy_mwh, sum(power_mw) AS actual_mw,
      sum(expected_power_mw) AS expected_mw, count(DISTINCT asset_id) AS asset_count FROM landings WHERE NOT behind
    GROUP BY 1, 2 HAVING timestamp_utc + INTERVAL 1 HOUR <= (SELECT max(timestamp_utc) FROM telemetry) - INTERVAL 3 HOUR""",
)
def _(t):
    """Hours come out as the watermark passes them; readings behind it are left to the late merge."""
    out = new_path(t.spark, "hourly")
    hourly = ingest.portfolio_hourly_stream(landed_in_time(t), "3 hours")
    ingest.append_table(hourly, out, new_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out)


@query(
    "stream_dedup",
    "asset_id:s n:i",
    f"WITH {LANDING_SQL} SELECT asset_id, count(DISTINCT timestamp_utc) AS n FROM landings WHERE NOT behind GROUP BY asset_id",
)
def _(t):
    """One copy of each asset and hour; keys are forgotten three hours later, and readings behind that are left out."""
    out = new_path(t.spark, "dedup")
    ingest.append_table(ingest.dedup_stream(landed_in_time(t), "3 hours"), out, new_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


def split_landings(t):
    main, late = new_path(t.spark, "main"), new_path(t.spark, "late")
    ingest.run_batches(landed_in_time(t), ingest.split_behind(main, late, 3 * 3600), new_path(t.spark, "checkpoint"))
    return main, late


@query(
    "stream_behind",
    "part:s batch_id:i n:i first_id:i last_id:i",
    f"""WITH {LANDING_SQL} SELECT CASE WHEN behind THEN 'late' ELSE 'main' END AS part, CASE WHEN behind THEN period + 3 ELSE period END AS batch_id,
      count(*) AS n, min(event_sequence) AS first_id, max(event_sequence) AS last_id FROM landings GROUP BY 1, 2""",
)
def _(t):
    """Readings behind the watermark of their batch, and the others."""
    parts = [t.spark.read.parquet(p).withColumn("part", F.lit(n)) for n, p in zip(("main", "late"), split_landings(t), strict=True)]
    return parts[0].unionByName(parts[1]).groupBy("part", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_sequence").alias("first_id"), F.max("event_sequence").alias("last_id")
    )


@query("stream_behind_merge", GOLD_SPEC, f"WITH {GOLD_SQL} SELECT * FROM gold")
def _(t):
    """The mart of the readings before the watermark, with those behind it merged into their hours: nothing is lost."""
    main, late = split_landings(t)
    bronze, gold = new_path(t.spark, "bronze"), new_path(t.spark, "gold")
    ingest.refresh_gold(bronze, gold)(t.spark.read.parquet(main).drop("batch_id"), 0)
    ingest.merge_late(late, bronze, gold)(t.spark, 0)
    return t.spark.read.parquet(gold)


@query(
    "late_events",
    "event_sequence:i asset_id:s timestamp_utc:t ingested_at:t",
    f"WITH {TELEMETRY_SQL} SELECT * FROM telemetry WHERE ingested_at - timestamp_utc > INTERVAL 45 MINUTE",
)
def _(t):
    return ingest.late_rows(t.telemetry, 45 * 60)


@query(
    "stream_late_split",
    "part:s n:i",
    f"""WITH {TELEMETRY_SQL} SELECT CASE WHEN ingested_at - timestamp_utc > INTERVAL 45 MINUTE THEN 'late' ELSE 'main' END AS part,
      count(*) AS n FROM telemetry GROUP BY 1""",
)
def _(t):
    main, late = new_path(t.spark, "main"), new_path(t.spark, "late")
    ingest.run_batches(
        telemetry_stream(t), ingest.split_late(main, late, 45 * 60), new_path(t.spark, "checkpoint")
    )
    parts = [
        t.spark.read.parquet(path).select(F.lit(name).alias("part"))
        for name, path in (("main", main), ("late", late))
    ]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "silent_assets",
    "asset_id:s last_seen_at:t silence_s:i silent:b",
    f"""WITH {TELEMETRY_SQL} SELECT asset_id, max(timestamp_utc) AS last_seen_at,
      epoch(TIMESTAMP '2024-01-31 00:00:00' - max(timestamp_utc)) AS silence_s,
      epoch(TIMESTAMP '2024-01-31 00:00:00' - max(timestamp_utc)) > 7200 AS silent FROM telemetry GROUP BY asset_id""",
)
def _(t):
    return monitors.silence(t.telemetry, 7200, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query(
    "stream_silence",
    "asset_id:s last_seen_s:i silent:b",
    f"""WITH {TELEMETRY_SQL}, seen AS (SELECT DISTINCT asset_id, epoch(timestamp_utc) AS s FROM telemetry),
    gaps AS (SELECT asset_id, s, coalesce(lead(s) OVER (PARTITION BY asset_id ORDER BY s), (SELECT max(s) FROM seen)) - s AS gap FROM seen)
    SELECT asset_id, s AS last_seen_s, TRUE AS silent FROM gaps WHERE gap > 7200""",
)
def _(t):
    out = new_path(t.spark, "silence")
    path = new_path(t.spark, "landing")
    # four landings, one after another in time
    edges = [F.lit(f"2024-01-{day:02d}").cast("timestamp") for day in (1, 9, 17, 25)]
    for k, low in enumerate(edges):
        ts = F.col("timestamp_utc")
        part = t.telemetry.where((ts >= low) if k else F.lit(True)).where((ts < edges[k + 1]) if k < 3 else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.bronze_stream(t.spark, path, t.telemetry.schema, 1)
    alerts = monitors.freshness_monitor(stream, 7200)
    ingest.append_table(alerts, out, new_path(t.spark, "checkpoint"))
    return t.spark.read.schema("asset_id string, last_seen_s long, silent boolean").parquet(out)


LOGS_SQL = """logs AS (
  SELECT 'client-' || CAST(user_id % 12 AS VARCHAR) AS client, ts, event_id AS request_id,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value / CAST(100 AS DOUBLE) AS latency_s FROM events
)"""


def request_logs(events):
    return events.select(
        F.concat(F.lit("client-"), (F.col("user_id") % 12).cast("string")).alias("client"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / F.lit(100.0)).alias("latency_s"),
    )


@query(
    "request_alerts",
    "window_start:t requests:i errors:i p95_latency_s:d error_alert:b latency_alert:b",
    f"""WITH {LOGS_SQL}, w AS (
      SELECT logs.*, date_trunc('minute', ts) - to_minutes(k) AS window_start FROM logs CROSS JOIN range(5) r(k))
    SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors,
      quantile_disc(latency_s, 0.95) AS p95_latency_s,
      CAST(count(*) FILTER (WHERE status_code >= 500) AS DOUBLE) / count(*) > CAST(0.05 AS DOUBLE) AS error_alert,
      quantile_disc(latency_s, 0.95) > CAST(0.5 AS DOUBLE) AS latency_alert FROM w GROUP BY window_start""",
)
def _(t):
    return monitors.request_alerts(request_logs(t.read("events")))


@query(
    "hourly_errors",
    "hour:t errors:i",
    f"WITH {LOGS_SQL} SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE status_code >= 500) AS errors FROM logs GROUP BY 1",
)
def _(t):
    return monitors.hourly_errors(request_logs(t.read("events")))


RATE_SQL = f"""WITH RECURSIVE {LOGS_SQL}, ordered AS (
  SELECT client, request_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS pos FROM logs
),
walk AS (
  SELECT client, request_id, pos, FALSE AS limited, [us] AS accepted FROM ordered WHERE pos = 1
  UNION ALL
  SELECT client, request_id, pos, len(live) >= 2, CASE WHEN len(live) >= 2 THEN live ELSE list_append(live, us) END FROM (
    SELECT o.client, o.request_id, o.pos, o.us, list_filter(w.accepted, lambda x: x > o.us - 3600000000) AS live
    FROM walk w JOIN ordered o ON o.client = w.client AND o.pos = w.pos + 1)
)
SELECT client, request_id, limited FROM walk"""


@query("rate_flag", "client:s request_id:i limited:b", RATE_SQL)
def _(t):
    return monitors.rate_flag(request_logs(t.read("events")), limit=2, window_s=3600)


@query("stream_rate_flag", "client:s request_id:i limited:b", RATE_SQL)
def _(t):
    """Requests land in the order of their arrival, up to an hour after their time, in four batches that overlap."""
    path, out = new_path(t.spark, "landing"), new_path(t.spark, "rate")
    logs = request_logs(t.read("events")).select("client", "request_id", "ts")
    arrival = F.col("ts") + F.make_dt_interval(secs=F.pmod(F.hash("request_id"), F.lit(3600)))
    quarter = F.ntile(4).over(Window.orderBy("_day"))
    days = logs.select(F.to_date(arrival).alias("_day")).distinct().withColumn("_part", quarter)
    placed = materialize(logs.withColumn("_day", F.to_date(arrival)).join(days, "_day").drop("_day"), "arrivals")
    for k in range(1, 5):
        placed.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    # a row without an id, two days later, closes the last cells
    end = placed.agg(F.lit("client-0").alias("client"), F.lit(None).cast("bigint").alias("request_id"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.bronze_stream(t.spark, path, logs.schema, 1)
    flagged = monitors.rate_flag_stream(stream, limit=2, window_s=3600, delay="1 hour", cell_s=3600)
    ingest.append_table(flagged, out, new_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out)
