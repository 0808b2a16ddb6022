"""Manifests, hashes, audit chains, lineage and sensitive-data scans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmill.operators.quality import schema_fingerprint
from voltmill.operators.silver import expect
from voltmill.session import materialize
from voltmill.sources.tables import file_checksums

GENESIS = "GENESIS"
SEQ_BUCKET = 100_000
MAX_DOCUMENT_BYTES = 5 * 1024 * 1024

# Patterns that may not appear in published data.
FORBIDDEN_KEY = r"(?i)(?:^|_)(?:password|passwd|secret|token|api_key|access_key|private_key)(?:$|_)"
FORBIDDEN_VALUE = (
    r"(?:[A-Za-z]:\\(?:Users|ProgramData)\\|/(?:home|root|Users)/|"
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|AKIA[0-9A-Z]{16})"
)


def _ordered(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of structs and the entries of maps in the order of their names, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        built = F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), built)
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))))
        if isinstance(kind.valueType, (T.StructType, T.MapType, T.ArrayType)):
            keys = F.array_sort(F.map_keys(value))
            return F.map_from_arrays(keys.cast("array<string>"), F.transform(keys, lambda k: _ordered(value[k], kind.valueType)))
        return F.map_from_entries(entries)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return value


def canonical(columns: Sequence[str], schema: T.StructType | None = None) -> Column:
    """JSON of the name-sorted columns; missing values are left out.

    With the ``schema`` of the frame, nested structs and maps are sorted too, so equal values give equal text.
    """
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    return F.to_json(F.struct(*[_ordered(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in sorted(columns)]))


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and a hash that does not depend on row order.

    Each row adds the first 60 bits of its own hash to an exact sum, so the
    work is one map-side aggregate.
    """
    chosen = list(columns or df.columns)
    bits = F.conv(F.substring(F.sha2(canonical(chosen, df.schema), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(bits), F.lit(0).cast("decimal(30,0)")).alias("_sum"),
    ).select(
        "row_count",
        F.concat(
            F.lit("sha256:"),
            F.sha2(F.concat_ws(":", F.col("_sum").cast("string"), F.col("row_count").cast("string")), 256),
        ).alias("content_hash"),
    )


def manifest(
    df: DataFrame,
    dataset_id: str,
    run_id: str,
    ts: str = "timestamp_utc",
    hash_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One-row description of a dataset.

    ``source_ids`` is the sorted set of source ids, a registry vocabulary.
    """
    facts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("min_timestamp"),
        F.max(ts).alias("max_timestamp"),
        F.sort_array(F.collect_set("source_id")).alias("source_ids"),
        F.coalesce(F.bool_or("is_synthetic"), F.lit(False)).alias("contains_synthetic_data"),
    )
    return facts.withColumns(
        {
            "dataset_id": F.lit(dataset_id),
            "dataset_version": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HHmmss'Z'"),
            "run_id": F.lit(run_id),
            "schema_hash": F.lit(schema_fingerprint(df)),
            "content_hash": content_hash(df, hash_columns).select("content_hash").scalar(),
            "quality_status": F.lit("passed"),
        }
    )


def verify_manifests(spark: SparkSession, path: str, expected: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """Expected (file, checksum) rows against the files below ``path``."""
    measured = file_checksums(spark, path, glob).select("file", F.col("checksum").alias("_measured"))
    return expected.select("file", "checksum").join(measured, "file", "full_outer").select(
        "file",
        F.when(F.col("_measured").isNull(), "missing")
        .when(F.col("checksum").isNull(), "unexpected")
        .when(F.col("checksum") == F.col("_measured"), "match")
        .otherwise("mismatch")
        .alias("outcome"),
    )


def _placed(events: DataFrame, chain: str, seq: str, columns: Sequence[str] | None) -> DataFrame:
    """Events with the digest of their content (all but chain and hashes) and a bucket that grows with their sequence number.

    Events without a chain or a number are left out.
    """
    content = [c for c in columns or events.columns if c not in (chain, "previous_hash", "event_hash")]
    digest = F.unhex(F.sha2(canonical(content, events.schema), 256))
    bucket = F.floor(F.col(seq) / SEQ_BUCKET).cast("long")
    return events.withColumns({"_digest": digest, "_bucket": bucket}).where(F.col(chain).isNotNull() & F.col("_bucket").isNotNull())


def _link(previous: Column, digest: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("\n"), F.lower(F.hex(digest))), 256)


def _next_hash(last: str, digest: bytes) -> str:
    return hashlib.sha256(f"{last}\n{digest.hex()}".encode()).hexdigest()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last hash before each bucket of ordered rows (chain, bucket, digest); only that hash is carried along."""
    chain, bucket, last = None, None, GENESIS
    for batch in batches:
        starts, entries = [], []
        for row, (name, part, digest) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if name != chain:
                chain, bucket, last = name, None, GENESIS
            if part != bucket:
                bucket = part
                starts.append(row)
                entries.append(last)
            last = _next_hash(last, digest)
        at = pa.array(starts, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(entries, pa.string())], ["_chain", "_part", "_entry"])


def _fold(chain: str):
    """Add both hashes to rows ordered by chain and bucket, from the hash before each bucket on."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, ""
        for batch in batches:
            previous, hashes = [], []
            for *place, entry, digest in zip(*(batch.column(c).to_pylist() for c in (chain, "_bucket", "_entry", "_digest")), strict=True):
                if place != at:
                    at, last = place, entry
                previous.append(last)
                last = _next_hash(last, digest)
                hashes.append(last)
            kept = batch.drop_columns(["_bucket", "_entry", "_digest"])
            yield kept.append_column("previous_hash", pa.array(previous, pa.string())).append_column("event_hash", pa.array(hashes, pa.string()))

    return fold


def append_events(events: DataFrame, chain: str = "chain_id", seq: str = "seq", columns: Sequence[str] | None = None) -> DataFrame:
    """Link events of every chain in sequence order: each carries the hash of the one before it, the first ``GENESIS``.

    The hash covers the previous hash and the digest of the event's content, so changing an event changes all later
    hashes and the head. A hash chain is sequential by nature: contents are digested in parallel, and only the digests
    of a chain run through one task, row after row, with nothing held but the last hash. That pass hands out the hash
    before each bucket; the events themselves are shuffled once, by bucket, and linked there side by side. Equal
    numbers are taken in the order of their digests, so that both passes agree.
    """
    kept = [c for c in events.columns if c not in ("previous_hash", "event_hash")]
    # written, so that both passes see the same events
    placed = materialize(_placed(events, chain, seq, columns).select(*kept, "_digest", "_bucket"), "events")
    order = (chain, "_bucket", seq, "_digest")
    light = placed.select(*dict.fromkeys(order)).repartition(chain).sortWithinPartitions(*order).select(chain, "_bucket", "_digest")
    kind = events.schema[chain].dataType.simpleString()
    entries = materialize(light.mapInArrow(_entries, f"_chain {kind}, _part bigint, _entry string"), "entries")
    same = (F.col(chain) == F.col("_chain")) & (F.col("_bucket") == F.col("_part"))
    ordered = placed.join(entries, same).drop("_chain", "_part").repartition(chain, "_bucket").sortWithinPartitions(*order)
    fields = [T.StructField(c, events.schema[c].dataType) for c in kept]
    hashes = [T.StructField(c, T.StringType()) for c in ("previous_hash", "event_hash")]
    return ordered.mapInArrow(_fold(chain), T.StructType(fields + hashes))


def verify_chain(events: DataFrame, chain: str = "chain_id", seq: str = "seq", columns: Sequence[str] | None = None, damaged: str | None = None) -> DataFrame:
    """Per chain: validity, number of events and index of the first bad event.

    An event is bad when its hash does not match its content, when its previous hash is not the one stored by its
    predecessor, or when the column ``damaged`` holds the text that could not be read. Every event is checked by
    itself, then against its neighbour in its bucket, so one chain is spread over all tasks and only hashes are
    shuffled, once; the first event of a bucket is compared with the last one of the bucket before.
    """
    good = F.col("event_hash").eqNullSafe(_link(F.col("previous_hash"), F.col("_digest")))
    if damaged:
        good = good & F.col(damaged).isNull()
    number = F.col(seq).alias("_seq")
    hashes = _placed(events, chain, seq, columns).select(F.col(chain).alias("_chain"), "_bucket", number, "previous_hash", "event_hash", good.alias("_good"))
    inside = Window.partitionBy("_chain", "_bucket").orderBy("_seq")
    rows = hashes.withColumns({"_row": F.row_number().over(inside), "_before": F.lag("event_hash").over(inside)})
    follows = (F.col("_row") == 1) | F.col("previous_hash").eqNullSafe(F.col("_before"))
    buckets = rows.groupBy("_chain", "_bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(~(F.col("_good") & follows), F.col("_row"))).alias("_bad"),
        F.max(F.when(F.col("_row") == 1, F.col("previous_hash"))).alias("_enters"),
        F.max_by("event_hash", "_row").alias("_leaves"),
    )
    along = Window.partitionBy("_chain").orderBy("_bucket")
    offset = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.withColumns({"_offset": offset, "_stored": F.lag("_leaves").over(along)})
    expected = F.when(F.col("_offset") == 0, F.lit(GENESIS)).otherwise(F.col("_stored"))
    first = F.when(F.col("_enters").eqNullSafe(expected), F.col("_bad")).otherwise(F.lit(1))
    return placed.withColumn("_first", F.col("_offset") + first - 1).groupBy(F.col("_chain").alias(chain)).agg(
        (F.count("_first") == 0).alias("valid"), F.min("_first").alias("first_bad_index"), F.sum("_n").alias("events")
    )


def evidence_hash(columns: Sequence[str]) -> Column:
    """Hash over the name-sorted fields of an approval receipt."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical(columns), 256))


LEDGER = (
    "position int, source string, target string, rows_in bigint, rows_out bigint, violations map<string,bigint>,"
    " schema_hash string, status string, started_at timestamp, finished_at timestamp, run_id string"
)


@dataclass(frozen=True)
class Stage:
    """A table of a run: made by ``build`` from the table before (None for the first), with rules that its rows should keep."""

    name: str
    build: Callable[[DataFrame | None], DataFrame]
    rules: dict[str, str] = field(default_factory=dict)


def run_stages(spark: SparkSession, stages: Sequence[Stage], root: str, ledger: str, run_id: str) -> dict[str, DataFrame]:
    """Write every stage below ``root`` and record the run in the append table ``ledger``; returns the tables read back.

    Rows and broken rules are counted by the write itself, at its last
    operator: a task that runs again counts once, and no table is read to be
    counted. A stage's input is what the stage before has written. The rows of
    a run are one partition of the ledger, so a repeated run replaces its own
    and other runs stay. A stage that fails is recorded as failed, without
    counts, and ends the run.
    """
    tables, records = {}, []
    before, rows_in, source = None, None, None
    try:
        for position, stage in enumerate(stages):
            started = datetime.now(UTC)
            path = f"{root}/run_id={run_id}/{stage.name}"
            try:
                watched, observed = expect(stage.build(before), stage.rules, "warn")
                watched.write.mode("overwrite").option("compression", "zstd").parquet(path)
            except Exception:
                records.append((position, source, stage.name, rows_in, None, None, None, "failed", started, datetime.now(UTC), run_id))
                raise
            counts = dict(observed.get)
            rows = counts.pop("rows")
            status = "empty" if not rows else "violated" if any(counts.values()) else "verified"
            fingerprint = schema_fingerprint(watched)
            records.append((position, source, stage.name, rows_in, rows, counts, fingerprint, status, started, datetime.now(UTC), run_id))
            before = tables[stage.name] = spark.read.schema(watched.schema).parquet(path)
            rows_in, source = rows, stage.name
    finally:
        # one row for each stage
        rows = spark.createDataFrame(records, LEDGER)
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(ledger)
    return tables


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All recorded runs."""
    return spark.read.schema(LEDGER).parquet(ledger)


def lineage(spark: SparkSession, ledger: str, run_id: str) -> DataFrame:
    """One edge per neighbouring pair of stages of a run, with the rows on both sides."""
    edges = read_ledger(spark, ledger).where((F.col("run_id") == run_id) & F.col("source").isNotNull())
    return edges.select("run_id", (F.col("position") - 1).alias("position"), "source", "target", "rows_in", "rows_out", "status")


def rule_counts(spark: SparkSession, ledger: str, run_id: str) -> DataFrame:
    """Rows that break a rule, for each stage and rule of a run."""
    recorded = read_ledger(spark, ledger).where(F.col("run_id") == run_id)
    return recorded.select("run_id", F.col("target").alias("stage"), F.explode("violations").alias("rule", "violations"), F.col("rows_out").alias("row_count"))


def ingestion_status(results: DataFrame) -> DataFrame:
    """Run status over rows (run_id, source_id, status, required)."""
    ok = F.col("status") == "success"
    return results.groupBy("run_id").agg(
        F.when(F.bool_and(ok | ~F.col("required")), "passed").otherwise("partial").alias("status"),
        F.count_if(F.col("required") & ok).alias("required_successes"),
        F.count_if("required").alias("required_sources"),
    )


def isolate_failures(results: DataFrame) -> DataFrame:
    """Failed sources keep their fallback; the others pass through."""
    return results.withColumn(
        "serving_source",
        F.when(F.col("status") == "success", F.col("source_id")).otherwise(F.col("fallback_source")),
    )


def scan_sensitive(
    df: DataFrame,
    key_pattern: str = FORBIDDEN_KEY,
    value_patterns: dict[str, str] | None = None,
    max_bytes: int = MAX_DOCUMENT_BYTES,
) -> DataFrame:
    """Findings (location, rule, rows) over every field of every row, one pass.

    Field names and map keys are tested against ``key_pattern``, strings at
    any depth against the value patterns, numbers for NaN and infinity, and
    each row's JSON size against ``max_bytes``. Zero counts are left out.
    """
    patterns = value_patterns or {"forbidden_value": FORBIDDEN_VALUE}
    tests: list[tuple[str, str, Column]] = []
    for field in df.schema.fields:
        _walk(field.name, F.col(field.name), field.dataType, f"$.{field.name}", key_pattern, patterns, tests)
    tests.append(("$", "document_too_large", F.octet_length(F.to_json(F.struct("*"))) > max_bytes))
    named = {f"t{i}": test for i, (_, _, test) in enumerate(tests)}
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in named.items()])
    entries = F.array(
        *[
            F.struct(F.lit(location).alias("location"), F.lit(rule).alias("rule"), F.col(name).alias("rows"))
            for name, (location, rule, _) in zip(named, tests, strict=True)
        ]
    )
    return counts.select(F.explode(entries).alias("_f")).select("_f.*").filter(F.col("rows") > 0)


def _walk(name, value, kind, location, key_pattern, patterns, tests, wrap=lambda test: test) -> None:
    """Collect row tests for a field; ``wrap`` lifts a test over enclosing arrays."""
    import re

    if name is not None and re.search(key_pattern, name):
        tests.append((location, "forbidden_key", F.lit(True)))
    false = F.lit(False)
    if isinstance(kind, T.StringType):
        for rule, pattern in patterns.items():
            tests.append((location, rule, wrap(F.coalesce(F.rlike(value, F.lit(pattern)), false))))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        broken = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        tests.append((location, "non_finite", wrap(F.coalesce(broken, false))))
    elif isinstance(kind, T.StructType):
        for field in kind.fields:
            _walk(field.name, value[field.name], field.dataType, f"{location}.{field.name}",
                  key_pattern, patterns, tests, wrap)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        items = value if isinstance(kind, T.ArrayType) else F.map_values(value)
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            keyed = F.exists(F.map_keys(value), lambda k: F.rlike(k, F.lit(key_pattern)))
            tests.append((location, "forbidden_key", wrap(F.coalesce(keyed, false))))
        found: list[tuple[str, str]] = []
        probe: list = []
        _walk(None, F.lit(None).cast(inner), inner, f"{location}[*]", key_pattern, patterns, probe)
        found.extend((where, rule) for where, rule, _ in probe)
        for position, (where, rule) in enumerate(found):
            lifted = _item_test(position, inner, f"{location}[*]", key_pattern, patterns)
            tests.append((where, rule, wrap(F.coalesce(F.exists(items, lifted), false))))


def _item_test(position, kind, location, key_pattern, patterns):
    """The ``position``-th test of an array item, as a function of the item."""

    def test(item):
        inside: list = []
        _walk(None, item, kind, location, key_pattern, patterns, inside)
        return inside[position][2]

    return test
