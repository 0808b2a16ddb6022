"""Source, governance and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltmill.operators import governance, silver
from voltmill.plans.registry import query
from voltmill.plans.telemetry import SILVER_SQL, TELEMETRY_SQL
from voltmill.schemas import AUDIT
from voltmill.session import materialize, new_path
from voltmill.sources import envelopes, publish, tables
from voltmill.sources.tables import read_audit

HASHED = ("asset_id", "cents", "seq")
HASH_SQL = """hashed AS (
  SELECT *, sha256('{"asset_id":"' || asset_id || '","cents":' || CAST(coalesce(CAST(round(power_mw * 100) AS BIGINT), -1) AS VARCHAR)
    || ',"seq":' || CAST(event_sequence AS VARCHAR) || '}') AS h FROM silver
),
content AS (
  SELECT 'sha256:' || sha256(CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS HUGEINT)) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)) AS content_hash,
    count(*) AS row_count FROM hashed
)"""


def hashed(t):
    return t.silver.withColumns(
        {
            "cents": F.coalesce(F.round(F.col("power_mw") * 100).cast("long"), F.lit(-1)),
            "seq": F.col("event_sequence"),
        }
    )


@query("content_hash", "row_count:i content_hash:s", f"WITH {SILVER_SQL}, {HASH_SQL} SELECT * FROM content")
def _(t):
    return governance.content_hash(hashed(t), HASHED)


@query(
    "manifest",
    "dataset_id:s run_id:s row_count:i min_timestamp:t max_timestamp:t sources:s contains_synthetic_data:b content_hash:s quality_status:s",
    f"""WITH {SILVER_SQL}, {HASH_SQL} SELECT 'generation_silver' AS dataset_id, 'run-1' AS run_id, count(*) AS row_count,
      min(timestamp_utc) AS min_timestamp, max(timestamp_utc) AS max_timestamp,
      (SELECT string_agg(source_id, ',' ORDER BY source_id) FROM (SELECT DISTINCT source_id FROM silver WHERE source_id IS NOT NULL)) AS sources,
      bool_or(is_synthetic) AS contains_synthetic_data, (SELECT content_hash FROM content) AS content_hash, 'passed' AS quality_status FROM silver""",
)
def _(t):
    return governance.manifest(hashed(t), "generation_silver", "run-1", hash_columns=HASHED).withColumn(
        "sources", F.array_join("source_ids", ",")
    )


def audit_events(t):
    """One audit event per event row; a chain per day."""
    event = F.col("event_id")
    return t.read("events").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("chain_id"),
        event.alias("seq"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
        F.when(event % 9 == 0, "failure").otherwise("success").alias("result"),
    )


AUDIT_SQL = """audit AS (
  SELECT strftime(ts, '%Y-%m-%d') AS chain_id, event_id AS seq, 'user-' || CAST(user_id AS VARCHAR) AS actor, event_type AS action,
    CASE WHEN event_id % 9 = 0 THEN 'failure' ELSE 'success' END AS result FROM events
),
numbered_audit AS (
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) - 1 AS pos,
    '{"action":"' || action || '","actor":"' || actor || '","result":"' || result || '","seq":' || CAST(seq AS VARCHAR) || '}' AS body FROM audit
),
linked AS (
  SELECT chain_id, seq, pos, 'GENESIS' AS previous_hash, sha256('GENESIS' || chr(10) || sha256(body)) AS event_hash FROM numbered_audit WHERE pos = 0
  UNION ALL
  SELECT n.chain_id, n.seq, n.pos, l.event_hash, sha256(l.event_hash || chr(10) || sha256(n.body))
  FROM linked l JOIN numbered_audit n ON n.chain_id = l.chain_id AND n.pos = l.pos + 1
)"""


@query(
    "audit_append",
    "chain_id:s seq:i previous_hash:s event_hash:s",
    f"WITH RECURSIVE {AUDIT_SQL} SELECT * FROM linked",
)
def _(t):
    return governance.append_events(audit_events(t))


@query(
    "audit_verify",
    "chain_id:s valid:b first_bad_index:i events:i",
    """WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS chain_id, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS pos FROM events)
    SELECT chain_id, count(*) FILTER (WHERE event_id % 1700 = 7) = 0 AS valid, min(pos) FILTER (WHERE event_id % 1700 = 7) AS first_bad_index, count(*) AS events
    FROM n GROUP BY chain_id""",
)
def _(t):
    chained = governance.append_events(audit_events(t))
    tampered = chained.withColumn(
        "result", F.when(F.col("seq") % 1700 == 7, "edited").otherwise(F.col("result"))
    )
    return governance.verify_chain(materialize(tampered, "audit"))


FORGED_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS chain_id, event_id,
  row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS pos FROM events"""


@query(
    "audit_forgery",
    "chain_id:s events:i changed:i head_changed:b",
    f"""WITH n AS ({FORGED_SQL}), f AS (SELECT chain_id, count(*) AS events, min(pos) FILTER (WHERE event_id % 1700 = 7) AS first FROM n GROUP BY 1)
    SELECT chain_id, events, CASE WHEN first IS NULL THEN 0 ELSE events - first END AS changed, first IS NOT NULL AS head_changed FROM f""",
)
def _(t):
    """A forger who links the chain anew after an edit changes every later hash, and the head."""
    edited = F.when(F.col("seq") % 1700 == 7, "edited").otherwise(F.col("result"))
    old = governance.append_events(audit_events(t)).select("chain_id", "seq", "event_hash")
    new = governance.append_events(audit_events(t).withColumn("result", edited)).select("chain_id", "seq", F.col("event_hash").alias("forged"))
    both = old.join(new, ["chain_id", "seq"])
    heads = F.max_by(F.col("event_hash") != F.col("forged"), "seq")
    return both.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_hash") != F.col("forged")).alias("changed"), heads.alias("head_changed")
    )


@query(
    "audit_log",
    "chain_id:s events:i damaged:i valid:b first_bad_index:i",
    f"""WITH n AS ({FORGED_SQL}) SELECT chain_id, count(*) AS events, count(*) FILTER (WHERE event_id % 1700 = 7) AS damaged,
      count(*) FILTER (WHERE event_id % 1700 = 7) = 0 AS valid, min(pos) FILTER (WHERE event_id % 1700 = 7) AS first_bad_index FROM n GROUP BY 1""",
)
def _(t):
    """Chains written as JSON lines, some lines broken off, read back and verified."""
    event = audit_events(t).select(
        "chain_id",
        "seq",
        F.format_string("%012d", "seq").alias("event_id"),
        *(F.lit(x).alias(x) for x in ("timestamp", "resource", "resource_version", "correlation_id")),
        "actor",
        "action",
        "result",
        F.create_map(F.lit("z"), F.col("seq").cast("string"), F.lit("a"), F.col("actor")).alias("metadata"),
    )
    content = [f.name for f in AUDIT.fields if f.name not in ("previous_hash", "event_hash")]
    line = F.to_json(F.struct(*(f.name for f in AUDIT.fields)))
    broken = F.when(F.col("seq") % 1700 == 7, F.substring(line, 1, 40)).otherwise(line)
    path = new_path(t.spark, "audit-log")
    lines = governance.append_events(event, columns=content).select("chain_id", "seq", broken.alias("value"))
    lines.repartition("chain_id").sortWithinPartitions("chain_id", "seq").select("chain_id", "value").write.partitionBy("chain_id").text(path)
    log = read_audit(t.spark, path).withColumn("chain_id", F.regexp_extract("log_file", "chain_id=([^/]+)", 1))
    checked = governance.verify_chain(log.drop("log_file"), seq="line", columns=content, damaged="damaged")
    damaged = log.groupBy("chain_id").agg(F.count("damaged").alias("damaged"))
    return checked.join(damaged, "chain_id").select("chain_id", "events", "damaged", "valid", "first_bad_index")


@query(
    "evidence_hash",
    "asset_id:s evidence_hash:s",
    """SELECT DISTINCT 'ast-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS asset_id,
      'sha256:' || sha256('{"alias":"Champion","model":"ast-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || '"}') AS evidence_hash FROM events""",
)
def _(t):
    receipts = t.assets.select("asset_id", F.lit("Champion").alias("alias"), F.col("asset_id").alias("model"))
    return receipts.select("asset_id", governance.evidence_hash(["model", "alias"]).alias("evidence_hash"))


@query(
    "lineage",
    "run_id:s position:i source:s target:s rows_in:i rows_out:i status:s",
    f"""WITH {SILVER_SQL}, n AS (SELECT (SELECT count(*) FROM telemetry) AS b, (SELECT count(*) FROM silver) AS s,
      (SELECT count(*) FROM silver WHERE quality_flag = 'valid') AS g)
    SELECT 'run-1' AS run_id, 0 AS position, 'Bronze' AS source, 'Silver' AS target, b AS rows_in, s AS rows_out, 'verified' AS status FROM n
    UNION ALL SELECT 'run-1', 1, 'Silver', 'Valid', s, g, 'verified' FROM n""",
)
def _(t):
    """Edges of a run that writes three tables, counted by their writes; the run is repeated and stands once."""
    stages = [
        governance.Stage("Bronze", lambda _: t.telemetry),
        governance.Stage("Silver", silver.clean_generation),
        governance.Stage("Valid", lambda rows: rows.filter(F.col("quality_flag") == "valid")),
    ]
    root, ledger = new_path(t.spark, "run"), new_path(t.spark, "ledger")
    for run in ("run-1", "run-0", "run-1"):
        governance.run_stages(t.spark, stages if run == "run-1" else stages[:1], root, ledger, run)
    return governance.lineage(t.spark, ledger, "run-1")


RESULTS_SQL = """results AS (
  SELECT 'run-' || CAST(doc_id % 7 AS VARCHAR) AS run_id, source AS source_id, doc_id % 2 = 0 AS required, source || '-last' AS fallback_source,
    CASE WHEN doc_id % 7 < 4 AND doc_id % 50 = 4 THEN 'failed' ELSE 'success' END AS status, doc_id FROM documents
)"""


def source_results(t):
    doc = F.col("doc_id")
    return t.read("documents").select(
        doc,
        F.concat(F.lit("run-"), (doc % 7).cast("string")).alias("run_id"),
        F.col("source").alias("source_id"),
        (doc % 2 == 0).alias("required"),
        F.concat("source", F.lit("-last")).alias("fallback_source"),
        F.when((doc % 7 < 4) & (doc % 50 == 4), "failed").otherwise("success").alias("status"),
    )


@query(
    "ingestion_status",
    "run_id:s status:s required_successes:i required_sources:i",
    f"""WITH {RESULTS_SQL} SELECT run_id, CASE WHEN bool_and(status = 'success' OR NOT required) THEN 'passed' ELSE 'partial' END AS status,
      count(*) FILTER (WHERE required AND status = 'success') AS required_successes, count(*) FILTER (WHERE required) AS required_sources
    FROM results GROUP BY run_id""",
)
def _(t):
    return governance.ingestion_status(source_results(t))


@query(
    "isolated_failures",
    "doc_id:i serving_source:s",
    f"WITH {RESULTS_SQL} SELECT doc_id, CASE WHEN status = 'success' THEN source_id ELSE fallback_source END AS serving_source FROM results",
)
def _(t):
    return governance.isolate_failures(source_results(t))


# Patterns for the given documents; the default patterns are tested by hand.
DOCUMENT_PATTERNS = {
    "credential": r"(token|api_key|password|secret)\s*[=:]",
    "mail_address": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+",
}


@query(
    "sensitive_scan",
    "location:s rule:s rows:i",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '$.{c}' AS location, '{rule}' AS rule, count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS rows FROM {table}) WHERE rows > 0"
        for table, c in (("documents", "text"), ("documents", "source"), ("documents", "lang"))
        for rule, pattern in DOCUMENT_PATTERNS.items()
    ),
)
def _(t):
    return governance.scan_sensitive(t.read("documents"), value_patterns=DOCUMENT_PATTERNS)


@query(
    "sensitive_conversations",
    "location:s rule:s rows:i",
    """SELECT * FROM (SELECT '$.turns[*].text' AS location, 'mail_address' AS rule, count(*) AS rows FROM conversations
      WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[a-z]+')) WHERE rows > 0
    UNION ALL SELECT '$.token', 'forbidden_key', count(*) FROM conversations""",
)
def _(t):
    nested = t.read("conversations").select(
        F.array(F.struct("turn", "text")).alias("turns"), F.col("role").alias("token")
    )
    return governance.scan_sensitive(
        nested, value_patterns={"mail_address": DOCUMENT_PATTERNS["mail_address"]}
    )


# Payloads in the four published shapes: one per order line, with as many
# entries as its line number.
def payloads(t):
    entry = lambda i: F.struct(
        i.alias("l_linenumber"), (F.col("l_quantity") * i).alias("l_quantity"), "l_discount"
    )
    lines = t.read("lineitem").select(
        "l_orderkey", F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), entry).alias("items")
    )
    key = F.col("l_orderkey")
    number = lambda x: x["l_quantity"]
    cube = F.to_json(
        F.struct(
            F.map_from_arrays(
                F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: i.cast("string")),
                F.transform("items", number),
            ).alias("value")
        )
    )
    monthly = F.to_json(F.struct(F.struct(F.transform("items", number).alias("monthly")).alias("outputs")))
    mix = F.to_json(
        F.struct(
            F.transform(
                "items",
                lambda x: F.struct(
                    F.concat(F.lit("line "), x["l_linenumber"].cast("string")).alias("type"),
                    F.struct(
                        F.lit("Renovable").alias("type"),
                        F.array(
                            F.struct(
                                x["l_quantity"].alias("value"),
                                x["l_discount"].alias("percentage"),
                                F.lit("2025-07-20T00:00:00.000+02:00").alias("datetime"),
                            ),
                            F.struct(
                                (x["l_quantity"] * 2).alias("value"),
                                x["l_discount"].alias("percentage"),
                                F.lit("2025-07-21T00:00:00.000+02:00").alias("datetime"),
                            ),
                        ).alias("values"),
                    ).alias("attributes"),
                ),
            ).alias("included")
        )
    )
    records = F.to_json(F.struct(F.transform("items", number).alias("records")))
    other = F.to_json(F.struct(key.alias("order")))
    shapes = (cube, monthly, mix, records)
    payload = other
    for position, shape in enumerate(shapes):
        payload = F.when(key % 5 == position, shape).otherwise(payload)
    return lines.select(key.alias("order_key"), payload.alias("payload"))


@query(
    "payload_record_count",
    "order_key:i records:i",
    """SELECT l_orderkey AS order_key, CASE WHEN l_orderkey % 5 = 4 THEN 1 WHEN l_orderkey % 5 = 2 THEN 2 * l_linenumber ELSE l_linenumber END AS records
    FROM lineitem""",
)
def _(t):
    return payloads(t).select("order_key", envelopes.payload_record_count(F.col("payload")).alias("records"))


@query(
    "generation_mix",
    "order_key:i series:s type:s datetime_utc:t value:d percentage:d",
    """SELECT l_orderkey AS order_key, 'line ' || CAST(i AS VARCHAR) AS series, 'Renovable' AS type,
      TIMESTAMP '2025-07-19 22:00:00' + to_days(d) AS datetime_utc, l_quantity * i * (1 + d) AS value, l_discount AS percentage
    FROM lineitem JOIN range(1, 10) r(i) ON i <= l_linenumber CROSS JOIN (VALUES (0), (1)) v(d) WHERE l_orderkey % 5 = 2""",
)
def _(t):
    return envelopes.flatten_generation_mix(payloads(t), keep=("order_key",))


@query(
    "jsonstat_cells",
    "nation:s cell:i kind:s priority:s value:d",
    """WITH c AS (SELECT c_nationkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
    SELECT CAST(c_nationkey AS VARCHAR) AS nation,
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS cell,
      o_orderstatus AS kind, o_orderpriority AS priority, n AS value FROM c""",
)
def _(t):
    orders = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    cell = status * 5 + F.substring("o_orderpriority", 1, 1).cast("int") - 1
    counts = orders.groupBy("c_nationkey", cell.alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # one cube per nation, at most 15 cells each
    cubes = counts.groupBy("c_nationkey").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("string"), "n"))).alias("value")
    )
    index = lambda *names: F.struct(
        F.struct(
            F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]).alias("index")
        ).alias("category")
    )
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    payload = F.to_json(
        F.struct(
            "value",
            F.array(F.lit("kind"), F.lit("priority")).alias("id"),
            F.array(F.lit(3), F.lit(5)).alias("size"),
            F.create_map(F.lit("kind"), index("F", "O", "P"), F.lit("priority"), index(*priorities)).alias("dimension"),
        )
    )
    rows = cubes.select(F.col("c_nationkey").cast("string").alias("nation"), payload.alias("payload"))
    return envelopes.decode_jsonstat(rows, keep=("nation",)).select(
        "nation",
        "cell",
        F.col("coordinates")["kind"].alias("kind"),
        F.col("coordinates")["priority"].alias("priority"),
        "value",
    )


@query(
    "table_profile",
    "row_count:i min_timestamp:t max_timestamp:t passed:b",
    f"""WITH {TELEMETRY_SQL} SELECT count(*) AS row_count, min(timestamp_utc) AS min_timestamp, max(timestamp_utc) AS max_timestamp, TRUE AS passed FROM telemetry""",
)
def _(t):
    path = new_path(t.spark, "profile")
    profile = tables.write_partitioned(t.telemetry, path)
    check = tables.verify_profile(t.spark, path, profile)
    return profile.agg(
        F.sum("row_count").alias("row_count"),
        F.min("min_timestamp").alias("min_timestamp"),
        F.max("max_timestamp").alias("max_timestamp"),
    ).withColumn("passed", check.select("passed").scalar())
