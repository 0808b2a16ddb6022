"""Hand-checked expectations and negative cases."""

import datetime as dt
import json
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltmill.session import new_path
from voltmill.functions import physics, text
from voltmill.operators import (
    anomaly,
    drift,
    forecast,
    governance,
    inspection,
    isolation,
    joins,
    marts,
    quality,
    silver,
    storage,
)
from voltmill.sources import envelopes, publish, tables
from voltmill.streaming import monitors

START = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- storage ---


def request(spark, prices, capacity=10.0, power=4.0, **extra):
    rows = [("b", START + dt.timedelta(hours=i), p) for i, p in enumerate(prices)]
    frame = spark.createDataFrame(rows, "asset_id string, timestamp_utc timestamp, price_eur_mwh double")
    battery = spark.createDataFrame([("b", capacity, power)], "asset_id string, capacity_mwh double, max_power_mw double")
    for name, value in extra.items():
        battery = battery.withColumn(name, F.lit(value))
    return storage.dispatch_requests(frame, battery)


def test_dispatch_reference_plan(spark):
    plan = storage.battery_dispatch(request(spark, [20.0, 18.0, 25.0, 70.0, 90.0, 60.0]))
    rows = plan.orderBy("horizon_hour").collect()
    assert [r.charge_mw for r in rows] == [4.0, 1.2705, 0, 0, 0, 0]
    assert [r.discharge_mw for r in rows] == [0, 0, 0, 4.0, 4.0, 0]
    assert [r.state_of_charge_mwh for r in rows] == [8.7947, 10.0, 10.0, 5.7836, 1.5673, 1.5673]
    assert [r.cashflow_eur for r in rows] == [-80.0, -22.87, 0, 280.0, 360.0, 0]
    assert storage.dispatch_margin(plan).first().estimated_margin_eur == 537.13


def test_dispatch_second_plan(spark):
    plan = storage.battery_dispatch(request(spark, [18.0, 22.0, 35.0, 78.0, 91.0, 50.0]))
    row = storage.dispatch_margin(plan).first()
    assert (row.estimated_margin_eur, row.steps) == (576.05, 6)


def test_dispatch_invariants_on_random_prices(spark):
    rng = random.Random(3)
    plan = storage.battery_dispatch(request(spark, [rng.uniform(-20, 120) for _ in range(168)])).collect()
    assert len(plan) == 168
    for row in plan:
        assert 1.0 - 1e-6 <= row.state_of_charge_mwh <= 10.0 + 1e-6
        assert row.charge_mw == 0 or row.discharge_mw == 0


@pytest.mark.parametrize(
    ("prices", "options"),
    [
        ([1.0] * 169, {}),
        ([1.0, float("nan")], {}),
        ([1.0], {"capacity": 0.0}),
        ([1.0], {"reserve_fraction": 0.6}),
        ([1.0], {"roundtrip_efficiency": 1.2}),
    ],
)
def test_dispatch_rejects(spark, prices, options):
    requests = request(spark, prices, **options)
    assert storage.dispatch_rejects(requests).count() == 1
    assert storage.battery_dispatch(requests).count() == 0


# --- geography and physics ---


def test_haversine(spark):
    lit = lambda v: F.lit(float(v))
    near = one(spark, physics.haversine_km(lit(40.40), lit(-3.70), lit(40.4168), lit(-3.7038)))
    far = one(spark, physics.haversine_km(lit(40.40), lit(-3.70), lit(41.3874), lit(2.1686)))
    assert (round(near, 3), round(far, 3)) == (1.896, 505.248)


def test_nearest_station_cap(spark):
    point = spark.createDataFrame([(1, 40.40, -3.70)], "point_id int, latitude double, longitude double")
    both = spark.createDataFrame(
        [("mad", 40.4168, -3.7038), ("bcn", 41.3874, 2.1686)],
        "station_id string, latitude double, longitude double",
    )
    assert joins.nearest_station(point, both, 20.0).first().station_id == "mad"
    assert joins.nearest_station(point, both.filter("station_id = 'bcn'"), 20.0).first().station_id is None


def test_nearest_station_equals_brute_force_around_the_globe(spark):
    rng = random.Random(5)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(89, 90)]), rng.choice([rng.uniform(-180, 180), 179.9, -179.9]))
    points = [(i, *spot()) for i in range(120)]
    sites = [(f"s{i:03d}", *spot()) for i in range(150)]
    out = joins.nearest_station(
        spark.createDataFrame(points, "point_id int, latitude double, longitude double"),
        spark.createDataFrame(sites, "station_id string, latitude double, longitude double"),
        500.0,
    ).collect()

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 6371.0088 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    assert len(out) == len(points)
    for row in out:
        best = min((km(row.latitude, row.longitude, lat, lon), name) for name, lat, lon in sites)
        assert row.station_id == (best[1] if best[0] <= 500 else None)


def test_wind_curve(spark):
    value = lambda v: one(spark, physics.wind_expected(F.lit(100.0), F.lit(v)))
    assert [value(v) for v in (2.9, 3.0, 12.5, 25.0, 25.1)] == [0.0, 0.0, 100.0, 100.0, 0.0]


# --- drift ---


def drift_of(spark, reference, current):
    rows = [("g", float(v), False) for v in reference] + [("g", float(v), True) for v in current]
    return drift.psi(spark.createDataFrame(rows, "g string, value double, is_current boolean"), ["g"]).first().psi


def test_psi_values(spark):
    base = np.linspace(0, 1, 1000)
    assert drift_of(spark, base, base) < 1e-9
    assert round(drift_of(spark, base, np.linspace(0.7, 1.7, 1000)), 4) == 8.8192


def test_psi_degenerate(spark):
    assert drift_of(spark, [1.0] * 50, range(50)) == 0.0
    assert drift_of(spark, range(9), range(50)) == 0.0
    assert drift_of(spark, range(50), [float("nan")] * 50) == 0.0


def test_drift_steps(spark):
    status = lambda v: one(spark, drift.status_of(F.lit(v)))
    assert [status(v) for v in (0.25, 0.10, 0.0999)] == ["alert", "watch", "stable"]


# --- silver and contracts ---

READING = "technology string, installed_capacity_mw double, power_mw double, availability double"


@pytest.mark.parametrize(
    ("row", "policy", "flag"),
    [
        (("solar", 10.0, 5.0, 1.0), "valid", "valid"),
        (("solar", 10.0, 10.31, 1.0), "valid", "quarantined"),
        (("solar", 10.0, -0.01, 1.0), "valid", "quarantined"),
        (("battery", 10.0, -5.0, 1.0), "valid", "valid"),
        (("wind", 10.0, 5.0, 1.2), "valid", "quarantined"),
        (("wind", 10.0, None, 1.0), "valid", "valid"),
        (("wind", 10.0, None, 1.0), "quarantine", "quarantined"),
        (("wind", 10.0, 5.0, None), "quarantine", "quarantined"),
        (("battery", 10.0, None, 1.0), "quarantine", "valid"),
    ],
)
def test_flags(spark, row, policy, flag):
    df = spark.createDataFrame([row], READING)
    assert silver.flag_physical(df, policy).first().quality_flag == flag


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(START, float("nan"))], "timestamp_utc timestamp, v double")
    assert silver.normalize_utc(df).first().v is None


def test_expect_modes(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    rules = {"positive": "v > 0"}
    warned, seen = silver.expect(df, rules, "warn")
    assert warned.count() == 3 and seen.get == {"rows": 3, "positive": 2}
    assert silver.expect(df, rules, "drop")[0].count() == 1
    with pytest.raises(Exception, match="expectation failed"):
        silver.expect(df, rules, "fail")[0].collect()


def test_contract_reports_conflicts(spark):
    df = spark.createDataFrame(
        [("ab", "hydro", -1.0, 200, 5.0, 4.0, 6.0)],
        "asset_id string, technology string, power_mw double, horizon_hours int, p10_mw double, p50_mw double, p90_mw double",
    )
    broken = quality.contract_violations(df, "prediction").first().violations
    assert {"maximum:horizon_hours", "order:quantiles", "additional:technology", "required:model_version"} <= set(broken)


def test_schema_fingerprint_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert quality.schema_fingerprint(df) == quality.schema_fingerprint(df.select("y", "x"))
    assert quality.schema_fingerprint(df) != quality.schema_fingerprint(df.withColumn("z", F.lit(1)))


def test_json_shape(spark):
    shape = lambda value: quality._shape_text(json.dumps(value))
    assert shape({"b": [1, "x"], "a": {"c": None}}) == '{"a":{"c":"NoneType"},"b":["int"]}'
    assert shape({"a": {"b": {"c": {"d": {"e": 1}}}}}) == '{"a":{"b":{"c":{"d":"dict"}}}}'
    assert quality._shape_text("{") is None
    assert shape({"v": 1}) == shape({"v": 2})


# --- models and incidents ---


def test_champion_and_gates(spark):
    df = spark.createDataFrame(
        [("solar", "ridge", 2.0, 1.0, 0.5, 0.05, 0.8), ("solar", "extra_trees", 1.0, 3.0, 0.5, 0.2, 0.8)],
        "technology string, model string, validation_mae_mw double, mae_mw double,"
        " skill_vs_persistence double, nmae double, coverage_p10_p90 double",
    )
    ranked = {r.model: r for r in forecast.promotion_gates(forecast.rank_models(df)).collect()}
    assert ranked["extra_trees"].alias == "Champion" and ranked["ridge"].alias == "Challenger"
    assert not ranked["extra_trees"].gates_passed and ranked["ridge"].gates_passed


def test_approval_of_a_challenger_is_refused(spark):
    champions = spark.createDataFrame([("solar", "extra_trees")], "technology string, model string")
    requests = spark.createDataFrame(
        [("solar", "ridge", "Reviewer", "a long enough rationale text"), ("solar", "extra_trees", "Reviewer", "a long enough rationale text")],
        "technology string, model string, approver string, rationale string",
    )
    found = {r.model: r.rejection for r in forecast.approval_violations(requests, champions).collect()}
    assert found == {"ridge": "NOT_THE_CHAMPION", "extra_trees": None}


def test_retraining_invalidates_an_approval(spark):
    champions = spark.createDataFrame([("solar", "m")], "technology string, model string")
    approvals = spark.createDataFrame(
        [("solar", "m", "approved", "h1", "Reviewer")],
        "technology string, model string, status string, artifact_sha256 string, approver string",
    )
    state = lambda sha: forecast.approval_status(
        champions, spark.createDataFrame([("solar", sha)], "technology string, sha256 string"), approvals
    ).first().approval_status
    assert (state("h1"), state("h2")) == ("approved", "pending")


def test_severity_steps(spark):
    label = lambda v: one(spark, anomaly.severity(F.lit(v)))
    assert [label(v) for v in (55.1, 18.1, 5.1, 5.0)] == ["critical", "high", "medium", "low"]


def test_scenario_needs_its_technology(spark):
    assets = spark.createDataFrame([("a", "solar", 50.0)], "asset_id string, technology string, capacity_mw double")
    requests = spark.createDataFrame(
        [(1, "wind_vibration", "a", 1, 50, 10), (2, "soiling", "a", 1, 50, 10), (3, "soiling", "x", 1, 50, 10)],
        "request_id int, scenario string, asset_id string, seed int, severity int, duration_hours int",
    )
    rows = {r.request_id: r for r in joins.scenario_impact(requests, assets).collect()}
    assert rows[1].rejection == "requires a wind asset" and rows[1].run_id is None
    assert rows[2].estimated_mwh_at_risk == pytest.approx(45.0) and rows[2].detection_seconds == 49
    assert rows[3].rejection == "unknown asset"


def test_isolation_forest_finds_planted_rows_whatever_the_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))]
    rows += [(5000 + i, 9.0 + i, -9.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    score = lambda parts: {
        r.id: (r.isolation_score, r.anomaly_score)
        for r in isolation.isolation_forest(df.repartition(parts), ["id"], ["a", "b"], trees=50).collect()
    }
    first, second = score(2), score(7)
    assert first == second
    flagged = {i for i, (flag, _) in first.items() if flag > 0}
    assert set(range(5000, 5010)) <= flagged
    assert len(flagged) == pytest.approx(0.018 * len(rows), abs=2)


def test_isolation_sampling_of_a_large_table(spark):
    df = spark.range(20_000).select("id", F.rand(3).alias("a"))
    drawn = isolation.draw_samples(df, ["id"], ["a"], trees=5, sample=64, seed=1)
    counts = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(counts) == 5 and max(counts) <= 64 and min(counts) > 32


def test_detector_rules(spark):
    base = dict(
        asset_id="w", technology="wind", installed_capacity_mw=10.0, expected_power_mw=5.0, availability=1.0,
        temperature_c=10.0, curtailment_flag=False,
    )
    rows = []
    for i in range(8):
        at = START + dt.timedelta(hours=i)
        rows.append({**base, "timestamp_utc": at, "ingested_at": at, "event_sequence": i, "power_mw": 5.0,
                     "temperature_c": 10.0 + (i % 3 if i < 4 else 0)})
    rows[2]["power_mw"] = 5000.0
    rows[3]["ingested_at"] += dt.timedelta(days=3)
    rows[1].update(availability=0.0, power_mw=0.0)
    rows.append({**rows[0]})
    schema = (
        "asset_id string, technology string, installed_capacity_mw double, expected_power_mw double, availability double,"
        " temperature_c double, curtailment_flag boolean, timestamp_utc timestamp, ingested_at timestamp,"
        " event_sequence long, power_mw double"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = [set(r.detected) for r in anomaly.detect_rules(df, chunk_rows=4).orderBy("timestamp_utc").collect()]
    assert "duplicates" in got[0] and "total_outage" in got[1] and "unit_change" in got[2]
    assert "late_backfill" in got[3]
    assert "frozen_sensor" in got[7] and "frozen_sensor" not in got[3]


# --- inspection ---


def test_published_confusion_matrix(spark):
    cells = {("defective", "defective"): 93, ("defective", "functional"): 71,
             ("functional", "defective"): 36, ("functional", "functional"): 325}
    rows = [pair for pair, n in cells.items() for _ in range(n)]
    report = inspection.classification_report(spark.createDataFrame(rows, "t string, p string"), "t", "p")
    row = inspection.classification_summary(report).first()
    assert (round(row.accuracy, 4), round(row.balanced_accuracy, 4), round(row.macro_f1, 4)) == (0.7962, 0.7337, 0.7467)


def test_auc_with_ties_equals_pair_counting(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.choice([0.0, 0.25, 0.5, 0.5001, 0.75, 1.0])) for _ in range(300)]
    got = inspection.ranking_scores(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got.roc_auc == pytest.approx(wins / len(pos) / len(neg))


def test_triage(spark):
    rows = [("defective", 0.9, 40.0), ("defective", 0.6, 40.0), ("functional", 0.9, 40.0),
            ("functional", 0.7, 40.0), ("functional", 0.99, 2.5)]
    df = spark.createDataFrame(rows, "prediction string, confidence double, contrast double")
    got = [(r.severity, r.review_required, r.quality_score) for r in inspection.triage(df).collect()]
    assert got == [("high", True, None), ("medium", True, None), ("low", False, None), ("low", True, None), ("low", True, 0.5)]


# --- governance ---


def chain_of(spark, n, edit=None):
    rows = [("c", i, f"user-{i % 3}", "edited" if i == edit else "success", {"z": str(i), "a": "1"}) for i in range(n)]
    df = spark.createDataFrame(rows, "chain_id string, seq long, actor string, result string, metadata map<string,string>")
    return governance.append_events(df.repartition(4))


@pytest.mark.parametrize(("n", "bad"), [(2, 0), (100, 37), (100, 99)])
def test_tampering_is_found(spark, n, bad):
    chain = chain_of(spark, n)
    assert governance.verify_chain(chain).first().valid
    edited = chain.withColumn("result", F.when(F.col("seq") == bad, "edited").otherwise(F.col("result")))
    row = governance.verify_chain(edited).first()
    assert (row.valid, row.first_bad_index) == (False, bad)


def test_linked_forgery_changes_all_later_hashes(spark):
    old, new = ({r.seq: r.event_hash for r in chain_of(spark, 40, edit).collect()} for edit in (None, 3))
    assert [i for i in old if old[i] == new[i]] == [0, 1, 2]


def test_chain_is_plain(spark):
    import hashlib

    rows = sorted(chain_of(spark, 20).collect(), key=lambda r: r.seq)
    last = "GENESIS"
    for r in rows:
        body = f'{{"actor":"{r.actor}","metadata":{{"a":"1","z":"{r.seq}"}},"result":"{r.result}","seq":{r.seq}}}'
        digest = hashlib.sha256(body.encode()).hexdigest()
        assert r.previous_hash == last
        last = hashlib.sha256(f"{last}\n{digest}".encode()).hexdigest()
        assert r.event_hash == last


def test_canonical_form_ignores_order_at_every_depth(spark):
    kinds = "m map<string,struct<b:int,a:map<string,int>>>, l array<struct<z:int,y:int>>"
    first = spark.createDataFrame([({"q": (1, {"x": 1, "w": 2}), "p": None}, [(1, 2)])], kinds)
    second = spark.createDataFrame([([(2, 1)], {"p": None, "q": ({"w": 2, "x": 1}, 1)})], "l array<struct<y:int,z:int>>, m map<string,struct<a:map<string,int>,b:int>>")
    texts = {df.select(governance.canonical(["m", "l"], df.schema)).first()[0] for df in (first, second)}
    assert len(texts) == 1 and '"y":2,"z":1' in texts.pop()


def test_removed_event_is_found(spark):
    chain = chain_of(spark, 40).filter("seq <> 20")
    assert governance.verify_chain(chain).first().first_bad_index == 20


def test_verification_shuffles_hashes_only(spark, monkeypatch):
    """Contents are digested where they are read; neither they nor a copy of the events are written or shuffled."""
    monkeypatch.setattr(governance, "SEQ_BUCKET", 10)
    chain = chain_of(spark, 45).localCheckpoint()
    monkeypatch.setattr(governance, "materialize", None)
    first = lambda df: governance.verify_chain(df).first()
    assert (first(chain).valid, first(chain).first_bad_index, first(chain).events) == (True, None, 45)
    for bad in (0, 9, 10, 11, 44):
        edited = chain.withColumn("result", F.when(F.col("seq") == bad, "edited").otherwise(F.col("result")))
        assert first(edited).first_bad_index == bad
    for low, high in ((0, 0), (9, 9), (10, 10), (20, 29)):
        row = first(chain.filter(~F.col("seq").between(low, high)))
        assert (row.first_bad_index, row.events) == (low, 44 - high + low)


def test_chain_runs_on_over_buckets(spark, monkeypatch):
    """Equal numbers too are linked in one order; chains do not mix and rows without a chain or number are left out."""
    monkeypatch.setattr(governance, "SEQ_BUCKET", 7)
    rows = [(c, i // 2 if c == "b" else i, str(i)) for c in "ab" for i in range(30)] + [(None, 1, "x"), ("a", None, "y")]
    events = spark.createDataFrame(rows, "chain_id string, seq long, result string").repartition(5)
    linked = governance.append_events(events).collect()
    assert len(linked) == 60
    for chain in "ab":
        after = {r.previous_hash: r for r in linked if r.chain_id == chain}
        last, numbers = "GENESIS", []
        while last in after:
            numbers.append(after[last].seq)
            last = after[last].event_hash
        assert numbers == sorted(seq for c, seq, _ in rows if c == chain and seq is not None)


def test_lines_of_a_log_are_numbered_without_a_shuffle(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"event_id": "{name}{i:05d}"}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = tables.read_audit(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in log._jdf.queryExecution().executedPlan().toString()
        found = log.orderBy("log_file", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.event_id for r in found] == [f"{name}{i:05d}" for name in "ab" for i in range(5000)]
    assert len({(r.log_file, r.line) for r in found}) == 10_000


def test_genesis(spark):
    assert chain_of(spark, 3).orderBy("seq").first().previous_hash == "GENESIS"


def test_sensitive_fields_and_values(spark):
    def rules(df):
        return {(r.location, r.rule) for r in governance.scan_sensitive(df).collect()}

    assert rules(spark.createDataFrame([("x",)], "api_key string")) == {("$.api_key", "forbidden_key")}
    assert rules(spark.createDataFrame([("x",)], "checksum string")) == set()
    assert rules(spark.createDataFrame([("C:\\Users\\me",)], "path string")) == {("$.path", "forbidden_value")}
    assert rules(spark.createDataFrame([(float("nan"),)], "v double")) == {("$.v", "non_finite")}
    nested = spark.createDataFrame(
        [([{"a": ["ok", "/home/me/x"]}],)], "rows array<struct<a:array<string>>>"
    )
    assert rules(nested) == {("$.rows[*].a[*]", "forbidden_value")}
    keyed = spark.createDataFrame([({"my_token": "x"},)], "meta map<string,string>")
    assert rules(keyed) == {("$.meta", "forbidden_key")}
    assert rules(spark.range(1).select(F.repeat(F.lit("x"), 5 * 1024 * 1024 + 1).alias("t"))) == {
        ("$", "document_too_large")
    }


def test_publish_and_verify(spark, tmp_path):
    frames = {"mix": spark.createDataFrame([("solar", 1.0)], "technology string, share double")}
    files = publish.publish(frames, str(tmp_path), "2024-01-31")
    assert [r.outcome for r in governance.verify_manifests(spark, f"{tmp_path}/latest", files, "*.json").collect()] == ["match"]
    assert spark.read.json(f"{tmp_path}/history/date=2024-01-31/mix").count() == 1
    with pytest.raises(publish.PublicationError):
        publish.publish({"bad": spark.createDataFrame([("x",)], "password string")}, str(tmp_path), "2024-01-31")


def test_profile_detects_a_changed_file(spark, tables, tmp_path):
    path = str(tmp_path / "profile")
    expected = tables_profile(spark, tables, path)
    from voltmill.sources.tables import verify_profile

    assert verify_profile(spark, path, expected).first().passed
    wrong = expected.withColumn("checksum", F.lit("sha256:0"))
    assert not verify_profile(spark, path, wrong).first().passed
    assert not verify_profile(spark, path, expected, minimum_rows=10**9).first().passed


def tables_profile(spark, given, path):
    from voltmill.session import materialize

    return materialize(tables.write_partitioned(given.telemetry, path), "profile-manifest")


def test_content_hash_ignores_order_but_not_content(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    value = lambda d: governance.content_hash(d).first().content_hash
    assert value(df) == value(df.orderBy(F.col("id").desc()).repartition(3))
    assert value(df) != value(df.withColumn("v", F.col("v") + 1))


def test_lineage_is_recorded_by_the_run(spark):
    """Counts come from the writes; a repeated run stands once, others stay, a failed stage is on record."""
    stages = [
        governance.Stage("Bronze", lambda _: spark.range(50).repartition(7), {"small": "id < 45", "odd": "id % 2 = 1"}),
        governance.Stage("Silver", lambda rows: rows.where("id < 30").groupBy("id").count(), {"once": "count = 1"}),
        governance.Stage("Gold", lambda rows: rows.where("id < 0")),
    ]
    root, ledger = new_path(spark, "run"), new_path(spark, "ledger")
    for run in ("r", "other", "r"):
        out = governance.run_stages(spark, stages, root, ledger, run)
    assert {name: df.count() for name, df in out.items()} == {"Bronze": 50, "Silver": 30, "Gold": 0}
    edges = governance.lineage(spark, ledger, "r").orderBy("position").collect()
    assert [(r.position, r.source, r.target, r.rows_in, r.rows_out, r.status) for r in edges] == [
        (0, "Bronze", "Silver", 50, 30, "verified"), (1, "Silver", "Gold", 30, 0, "empty")]
    counts = governance.rule_counts(spark, ledger, "r").collect()
    assert {(r.stage, r.rule): (r.violations, r.row_count) for r in counts} == {
        ("Bronze", "small"): (5, 50), ("Bronze", "odd"): (25, 50), ("Silver", "once"): (0, 30)}
    broken = governance.Stage("Silver", lambda rows: rows.select(F.raise_error(F.lit("no")).alias("x")))
    with pytest.raises(Exception, match="no"):
        governance.run_stages(spark, [stages[0], broken], root, ledger, "r")
    runs = governance.read_ledger(spark, ledger).orderBy("run_id", "position").collect()
    assert [(r.run_id, r.target, r.rows_out, r.status) for r in runs] == [
        ("other", "Bronze", 50, "violated"), ("other", "Silver", 30, "verified"), ("other", "Gold", 0, "empty"),
        ("r", "Bronze", 50, "violated"), ("r", "Silver", None, "failed")]


# --- sources ---


def test_payload_counts(spark):
    payloads = [
        ({"value": {"0": 1, "1": 2}}, 2),
        ({"outputs": {"monthly": [1, 2, 3]}}, 3),
        ({"included": [{"attributes": {"values": [1, 2]}}, {"attributes": {"values": [1]}}, {}]}, 3),
        ({"records": [1]}, 1),
        ({"other": 1}, 1),
    ]
    df = spark.createDataFrame([(json.dumps(p), n) for p, n in payloads], "payload string, n long")
    rows = df.select("n", envelopes.payload_record_count(F.col("payload")).alias("got")).collect()
    assert all(r.n == r.got for r in rows)


def test_jsonstat_cube(spark):
    cube = {
        "value": {"0": 1.0, "4": 5.0},
        "id": ["kind", "geo", "time"],
        "size": [2, 3, 1],
        "dimension": {
            "kind": {"category": {"index": {"A": 0, "B": 1}}},
            "geo": {"category": {"index": {"ES": 0, "FR": 2, "DE": 1}}},
            "time": {"category": {"index": {"2024": 0}}},
        },
    }
    rows = envelopes.decode_jsonstat(spark.createDataFrame([(json.dumps(cube),)], "payload string")).collect()
    got = {r.cell: (r.coordinates, r.value) for r in rows}
    assert got[0] == ({"kind": "A", "geo": "ES", "time": "2024"}, 1.0)
    assert got[4] == ({"kind": "B", "geo": "DE", "time": "2024"}, 5.0)


def test_envelopes_audit_and_risks(spark, tmp_path):
    folder = tmp_path / "official" / "extraction_date=2024-01-01" / "run_id=r1"
    folder.mkdir(parents=True)
    mix = {"included": [{"type": "Wind", "id": "1", "attributes": {"title": "Wind", "type": "R", "values": [
        {"value": 1.5, "percentage": 0.5, "datetime": "2025-07-20T00:00:00.000+02:00"}]}}]}
    envelope = {"source_id": "s", "status_code": 200, "extracted_at": "2024-01-01T00:00:00Z",
                "response_headers": {"content-type": "application/json"}, "payload": mix}
    (folder / "payload.json").write_text(json.dumps(envelope, indent=2))
    df = envelopes.read_envelopes(spark, str(tmp_path / "official"))
    row = df.first()
    assert (row.source_id, str(row.extraction_date), row.run_id) == ("s", "2024-01-01", "r1")
    point = envelopes.flatten_generation_mix(df).first()
    assert (point.series, point.value, point.datetime_utc) == ("Wind", 1.5, dt.datetime(2025, 7, 19, 22))
    assert envelopes.payload_checksum_rows(df).first().records == 1

    log = tmp_path / "events.jsonl"
    log.write_text('{"event_id": "1", "actor": "a", "metadata": {"k": "v"}}\n\n{"event_id": "2"}\n')
    rows = tables.read_audit(spark, str(log)).orderBy("line").collect()
    assert [(r.event_id, r.damaged) for r in rows] == [("1", None), ("2", None)]
    log.write_text('{"event_id": "1"}\n\n{"event_id": "2", "act\n{}\n')
    rows = tables.read_audit(spark, str(log)).orderBy("line").collect()
    assert [r.damaged for r in rows] == [None, '{"event_id": "2", "act', "no event_id"]
    assert tables.read_audit(spark, str(tmp_path / "none.jsonl")).count() == 0

    csv = tmp_path / "risks.csv"
    csv.write_text("risk_id,category,title,likelihood,impact,inherent_risk,control,residual_risk,owner,status,evidence\n"
                   'R-1,Data,Outage,3,4,high,"retry, alert",medium,Ops,active,x.md\n')
    risk = tables.read_risks(spark, str(csv)).first()
    assert (risk.likelihood, risk.impact, risk.control) == (3, 4, "retry, alert")


def test_exports(spark, tables_dir, tables):
    gold = marts.portfolio_hourly(tables.silver)
    from voltmill.sources import tables as io

    io.export_latest(gold, f"{tables_dir}/latest", n=5)
    assert spark.read.json(f"{tables_dir}/latest").count() == 5
    io.export_csv(gold, f"{tables_dir}/csv")
    assert len(spark.read.option("header", True).csv(f"{tables_dir}/csv").columns) == 7
    fleet = marts.asset_rows(tables.assets, tables.silver)
    io.export_csv(fleet, f"{tables_dir}/fleet", io.FLEET_COLUMNS)
    assert spark.read.option("header", True).csv(f"{tables_dir}/fleet").columns == list(io.FLEET_COLUMNS)
    future = tables.silver.select(
        "timestamp_utc", "technology", *[F.col("power_mw").alias(c) for c in ("p10_mw", "p50_mw", "p90_mw")]
    )
    io.forecast_csv(future, "wind", f"{tables_dir}/forecast")
    assert spark.read.option("header", True).csv(f"{tables_dir}/forecast").columns[0] == "timestamp"
    io.write_table(gold, f"{tables_dir}/gold", partition_by=["technology"], cluster_by=["date_hour", "technology"])
    assert io.read_table(spark, f"{tables_dir}/gold").count() == gold.count()


@pytest.fixture
def tables_dir(tmp_path):
    return str(tmp_path)


# --- requests ---


def logs_of(spark, seconds, client="c"):
    rows = [(client, START + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "client string, ts timestamp, request_id long")


def test_request_121_is_limited(spark):
    flagged = monitors.rate_flag(logs_of(spark, [i * 0.4 for i in range(121)])).orderBy("request_id").collect()
    assert [r.limited for r in flagged] == [False] * 120 + [True]


def test_rate_flag_equals_a_sequential_pass(spark):
    rng = random.Random(9)
    seconds, now = [], 0.0
    for _ in range(3000):
        now += rng.choice([0.1, 0.2, 5.0, 90.0 if rng.random() < 0.02 else 0.3])
        seconds.append(round(now, 3))
    accepted, expected = [], []
    for s in seconds:
        accepted = [a for a in accepted if a > s - 60 + 1e-9]
        expected.append(len(accepted) >= 20)
        if not expected[-1]:
            accepted.append(s)
    flagged = monitors.rate_flag(logs_of(spark, seconds), limit=20, chunk_rows=40).orderBy("request_id").collect()
    assert [r.limited for r in flagged] == expected
    assert any(expected) and not all(expected)


def sequential(rows, limit, window_s):
    """Limited request ids of (client, seconds, id) by one pass per client."""
    limited, accepted = set(), {}
    for client, at, request in sorted(rows):
        own = accepted.setdefault(client, [])
        own[:] = [a for a in own if a > at - window_s]
        if len(own) >= limit:
            limited.add(request)
        else:
            own.append(at)
    return limited


@pytest.mark.parametrize("rounds", [1, 3, 50])
def test_a_client_that_is_never_calm_is_spread(spark, monkeypatch, rounds):
    """Nine tenths of the requests are one client's; its chunks run side by side until their states agree."""
    rng = random.Random(rounds)
    rows, now = [], 0
    for i in range(4000):
        now += rng.choice([0, 1, 1, 2, 3])
        rows.append(("hot" if i % 10 else rng.choice("ab"), now + (0 if i < 2000 else 500), i))
    tasks = []
    monkeypatch.setattr(monitors, "materialize", lambda df, label, own=monitors.materialize: tasks.append((label, out := own(df, label))) or out)
    frame = spark.createDataFrame([(c, START + dt.timedelta(seconds=s), i) for c, s, i in rows], "client string, ts timestamp, request_id long").repartition(5)
    flagged = monitors.rate_flag(frame, limit=7, window_s=40, chunk_rows=300, rounds=rounds)
    found = flagged.collect()
    assert sorted(r.request_id for r in found) == list(range(4000))
    assert {r.request_id for r in found if r.limited} == sequential(rows, 7, 40)
    decisions = [df for label, df in tasks if label == "decisions"]
    sizes = decisions[0].groupBy("client", "_bucket").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 320 and sizes[1] >= 12
    # a later round reads only what changed
    assert all(part.count() < decisions[0].count() for part in decisions[1:])


def test_requests_travel_without_null_lists(spark, monkeypatch):
    """Arrow's writer goes back to the last list that is no null for each null, so a run of them takes quadratic time."""

    def strict(limit, window_s, own=monitors._decide):
        def flag(batches):
            def seen():
                for batch in batches:
                    assert batch.column("_entry").null_count == 0
                    yield batch

            return own(limit, window_s)(seen())

        return flag

    monkeypatch.setattr(monitors, "_decide", strict)
    seconds = [0.5 * i for i in range(300)]
    flagged = monitors.rate_flag(logs_of(spark, seconds), limit=4, window_s=7, chunk_rows=100).collect()
    assert {r.request_id for r in flagged if r.limited} == sequential([("c", s, i) for i, s in enumerate(seconds)], 4, 7)


def test_limited_requests_are_not_gone_through_one_by_one():
    """The decision takes Python steps for accepted requests only."""
    rows = 20_000
    schema = pa.schema([("client", pa.string()), ("_bucket", pa.int64()), ("request_id", pa.int64()), ("_us", pa.int64()), ("_entry", pa.list_(pa.int64()))])
    columns = [["c"] * rows, [0] * rows, [None, *range(rows - 1)], [None, *range(0, 1000 * (rows - 1), 1000)], [[-500]] + [[]] * (rows - 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    steps, out = 0, []

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        out = list(monitors._decide(2, 1)(iter([batch])))
    finally:
        sys.settrace(before)
    decided = [r for part in out for r in part.to_pylist() if r["_exit"] is None]
    times = [-500, *range(0, 1000 * (rows - 1), 1000)]
    limited = sequential([("c", at, i) for i, at in enumerate(times)], 2, 1_000_000)
    assert {r["request_id"] + 1 for r in decided if r["limited"]} == limited
    assert len(decided) == rows - 1 and steps < 1000


def test_rate_flag_of_odd_rows(spark):
    rows = [("a", None, 1), (None, START, 2), ("a", START, 3), ("a", START, 4), ("a", START, 5), ("b", START, None)]
    frame = spark.createDataFrame(rows, "client string, ts timestamp, request_id long")
    found = sorted((r.client, r.request_id or 0, r.limited) for r in monitors.rate_flag(frame, limit=2).collect())
    assert found == [("a", 3, False), ("a", 4, False), ("a", 5, True), ("b", 0, False)]
    assert monitors.rate_flag(frame.limit(0)).collect() == []


# --- text ---


def test_text_helpers(spark):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    age = lambda s: one(spark, text.age_label(F.lit(s), now))
    assert [age(s) for s in ("2024-01-02T23:30:00Z", "2024-01-02T00:00:00Z", "2023-12-30T00:00:00Z", "nope", None)] == [
        "<1 h", "24 h", "4 d", "fecha no interpretable", "sin ejecución"]
    number = lambda v, d: one(spark, text.safe_number(F.lit(v), d))
    assert (number(0.125, 2), number(float("inf"), 1), number(float("nan"), 1)) == (0.12, 0.0, 0.0)
    clean = one(spark, text.sanitize_url(F.lit("https://h/p?a=1&API_KEY=x&b=#f"), ["api_key"]))
    assert clean == "https://h/p?a=1&b="
    assert one(spark, text.redact_path(F.lit("/var/x/secret.json"), "/srv")) == "redacted-local-path/secret.json"
    assert one(spark, text.cause_label(F.lit("some_new_cause"))) == "some new cause"
    assert one(spark, text.technology_label(F.lit("tidal"))) == "tidal"


def test_sun_over_a_year_and_a_day(spark):
    """Noon height is 90 degrees less the distance from latitude to declination; nights are dark and clouds dim."""
    rows = [(dt.datetime(2023, 6, 21, 12), 40.0, 0.0), (dt.datetime(2023, 12, 21, 12), 40.0, 0.0), (dt.datetime(2023, 6, 21, 0), 40.0, 0.0), (dt.datetime(2023, 6, 21, 12), 40.0, 1.0), (None, 40.0, 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, lat double, cloud double").coalesce(1)
    sun = physics.solar_irradiance(F.col("ts"), F.col("lat"), F.col("cloud"))
    got = df.select(F.degrees(F.asin(physics.solar_elevation(F.col("ts"), F.col("lat")))).alias("h"), sun.alias("g")).collect()
    assert got[0].h == pytest.approx(73.45, abs=0.05) and got[1].h == pytest.approx(26.55, abs=0.05)
    assert got[2].g == 0.0 and got[0].g > 2 * got[1].g > 0 and got[3].g == pytest.approx(0.25 * got[0].g) and got[4].g is None
