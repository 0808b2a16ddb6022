"""Stream state and batch handlers over several micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from voltmill.operators import marts, silver
from voltmill.session import new_path
from voltmill.streaming import ingest, monitors

START = dt.datetime(2024, 1, 1)


def land(spark, frames, schema):
    """One landing file per frame, older first."""
    path = new_path(spark, "landing")
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def test_silence_alert_fires_once_for_the_quiet_asset(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    frames = [
        [("a", at(0)), ("b", at(0))],
        [("a", at(1))],
        [("a", at(5))],
        [("a", at(6))],
    ]
    path, schema = land(spark, frames, "asset_id string, timestamp_utc timestamp")
    out = new_path(spark, "alerts")
    stream = monitors.freshness_monitor(ingest.bronze_stream(spark, path, schema, 1), 3 * 3600)
    ingest.append_table(stream, out, new_path(spark, "checkpoint"))
    alerts = spark.read.parquet(out).filter("asset_id = 'b'").collect()
    assert [(r.last_seen_s, r.silent) for r in alerts] == [(1704067200, True)]


def test_gold_refresh_equals_recompute_with_late_and_repeated_rows(spark, tables):
    rows = tables.telemetry.select(
        "event_sequence", "asset_id", "technology", "timestamp_utc", "ingested_at", "installed_capacity_mw",
        "power_mw", "energy_mwh", "expected_power_mw", "availability", "price_eur_mwh",
    )
    path = new_path(spark, "landing")
    rows.filter("event_sequence % 3 <> 0").coalesce(1).write.mode("append").parquet(path)
    rows.filter("event_sequence % 2 = 0").coalesce(1).write.mode("append").parquet(path)
    rows.coalesce(1).write.mode("append").parquet(path)
    gold = new_path(spark, "gold")
    stream = ingest.bronze_stream(spark, path, rows.schema, 1).drop("_ingested_at", "_source_file")
    ingest.run_batches(stream, ingest.refresh_gold(new_path(spark, "bronze"), gold), new_path(spark, "checkpoint"))
    expected = marts.portfolio_hourly(silver.clean_generation(rows))
    got = spark.read.parquet(gold).drop("event_date")
    outcome = marts.reconcile_summary(
        marts.reconcile(got, expected, ["date_hour", "technology"], ["energy_mwh", "expected_mw", "asset_count"])
    ).collect()
    assert [r.outcome for r in outcome] == ["match"]


def test_stream_resumes_and_new_columns_appear_after_a_restart(spark):
    path, schema = land(spark, [[("a", START, 1.0)]], "asset_id string, timestamp_utc timestamp, v double")
    out, checkpoint = new_path(spark, "bronze"), new_path(spark, "checkpoint")
    ingest.append_table(ingest.bronze_stream(spark, path, schema), out, checkpoint)
    spark.createDataFrame([("b", START, 2.0, "x")], "asset_id string, timestamp_utc timestamp, v double, extra string") \
        .coalesce(1).write.mode("append").parquet(path)
    wider = ingest.evolved_schema(spark, path)
    assert "extra" in wider.names
    ingest.append_table(ingest.bronze_stream(spark, path, wider), out, checkpoint)
    stored = spark.read.option("mergeSchema", True).parquet(out).orderBy("asset_id").collect()
    assert [(r.asset_id, r.extra) for r in stored] == [("a", None), ("b", "x")]


def test_late_rows_and_alerts(spark):
    df = spark.createDataFrame(
        [("a", START, START + dt.timedelta(days=3)), ("a", START, START + dt.timedelta(minutes=5))],
        "asset_id string, timestamp_utc timestamp, ingested_at timestamp",
    )
    assert ingest.late_rows(df, 3600).count() == 1
    logs = spark.createDataFrame(
        [(START + dt.timedelta(seconds=i), 500 if i < 6 else 200, 0.6 if i < 10 else 0.1) for i in range(100)],
        "ts timestamp, status_code int, latency_s double",
    )
    row = monitors.request_alerts(logs).orderBy(F.col("requests").desc(), "window_start").first()
    assert (row.requests, row.errors, row.error_alert, row.latency_alert) == (100, 6, True, True)
    assert monitors.hourly_errors(logs).first().errors == 6


def drain(spark, path, schema, build):
    """Everything that landed, file by file; the rows and the state that is left."""
    out = new_path(spark, "out")
    df = build(ingest.bronze_stream(spark, path, schema, 1))
    run = df.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    rows = spark.read.schema(df.schema).parquet(out).collect()
    return rows, run.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_silences_do_not_depend_on_the_order_of_readings_or_batches(spark):
    draw = random.Random(5)
    seen = {a: sorted({draw.randrange(0, 40_000) for _ in range(n)}) for a, n in (("a", 60), ("b", 25), ("c", 400), ("d", 1))}
    rows = [(a, START + dt.timedelta(seconds=s)) for a, at in seen.items() for s in at] + [(None, START), ("a", None)]
    rows.sort(key=lambda r: (r[1] or START) + dt.timedelta(seconds=draw.randrange(1500)))
    third = len(rows) // 3
    frames = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    frames.append([("z", START + dt.timedelta(seconds=60_000))])
    path, schema = land(spark, frames, "asset_id string, timestamp_utc timestamp")
    # batches of a few rows: a group comes in many pieces
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, left = drain(spark, path, schema, lambda df: monitors.freshness_monitor(df, 1800, delay="1500 seconds"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    zero = 1704067200
    expected = [(a, zero + s) for a, at in seen.items() for s, after in zip(at, [*at[1:], 10**9]) if after - s > 1800]
    assert sorted((r.asset_id, r.last_seen_s) for r in got) == sorted(expected)
    assert left < 20  # the open cell of the last reading and its timer


def test_rate_limit_of_a_stream_equals_the_requests_in_order(spark):
    draw = random.Random(9)
    rows = []
    for number in range(1200):
        client = "hot" if number % 10 else f"c{number % 3}"
        rows.append((client, 2**53 + number, START + dt.timedelta(milliseconds=draw.randrange(600_000) // 500 * 500)))
    rows += [(None, 1, START), ("hot", 2, None)]
    arrival = lambda r: (r[2] or START) + dt.timedelta(seconds=draw.randrange(45))
    rows.sort(key=arrival)
    frames = [rows[:500], rows[500:900], rows[900:], *([("end", None, START + dt.timedelta(days=d))] for d in (1, 2))]
    path, schema = land(spark, frames, "client string, request_id long, ts timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got, left = drain(spark, path, schema, lambda df: monitors.rate_flag_stream(df, 20, 30, delay="45 seconds", cell_s=20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    accepted = {}
    for client, number, at in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        live = [t for t in accepted.get(client, []) if t > at - dt.timedelta(seconds=30)]
        expected[number] = len(live) >= 20
        accepted[client] = live if expected[number] else [*live, at]
    assert {r.request_id: r.limited for r in got} == expected and len(got) == len(expected)
    assert any(expected.values()) and not all(expected.values())
    assert left == 0  # nothing is kept once windows have passed


def test_the_watermark_drops_state_and_late_rows_and_a_repeated_batch_replaces_itself(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    frames = [[("a", at(h + 100 * k), h) for h in range(100)] for k in range(4)]
    frames[3] += [("a", at(h), 0) for h in range(7)] + [("a", at(399), 1), ("a", None, 1)]
    path, schema = land(spark, frames, "asset_id string, timestamp_utc timestamp, n int")
    df = ingest.dedup_stream(ingest.bronze_stream(spark, path, schema, 1), "3 hours")
    run = df.writeStream.format("noop").option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    states = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 7
    assert states[-1]["numRowsTotal"] <= 8  # of 400 keys, those of the last hours and the one without a time

    main, late = new_path(spark, "main"), new_path(spark, "late")
    handle = ingest.split_behind(main, late, 3 * 3600)
    batches = [spark.createDataFrame(f, schema) for f in frames]
    for number in (0, 1, 2, 3, 3, 2):
        handle(batches[number], number)
    counts = lambda p: {r.batch_id: r["count"] for r in spark.read.parquet(p).groupBy("batch_id").count().collect()}
    assert counts(main) == {0: 100, 1: 100, 2: 100, 3: 102} and counts(late) == {3: 7}
    handle(batches[0].limit(0), 4)
    handle(batches[0], 5)  # the mark passes over an empty batch
    assert counts(late) == {3: 7, 5: 100}
