"""Freshness, request alerts and rate limits on streams and tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voltmill.operators.series import CHUNK_ROWS, place
from voltmill.session import materialize

# Alert thresholds and the request limit.
ERROR_RATIO = 0.05
LATENCY_P95_S = 0.5
RATE_LIMIT = 120
RATE_WINDOW_S = 60
#: Rounds in which chunks of a client's requests run side by side before it goes on in order.
RATE_ROUNDS = 6
#: Greatest time in microseconds.
LAST_US = 2**63 - 1


def silence(df: DataFrame, max_silence_s: int, now: Column, ts: str = "timestamp_utc") -> DataFrame:
    """Per asset: newest reading, seconds of silence and whether that is too long."""
    quiet = F.unix_seconds(now) - F.unix_seconds(F.max(ts))
    return (
        df.groupBy("asset_id")
        .agg(F.max(ts).alias("last_seen_at"), quiet.alias("silence_s"))
        .withColumn("silent", F.col("silence_s") > max_silence_s)
    )


class _Silence(StatefulProcessor):
    """Least and greatest second of every open cell of time, and the last second of the closed ones."""

    def __init__(self, max_silence_s: int):
        self.cell_s = max_silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "cell long", "low long, high long")
        self.last = handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for cell, seen in batch["seen_s"].groupby(batch["seen_s"] // self.cell_s):
                low, high = int(seen.min()), int(seen.max())
                before = self.open.getValue((int(cell),))
                if before is None:
                    self.handle.registerTimer((int(cell) + 1) * self.cell_s * 1000)
                else:
                    low, high = min(low, before[0]), max(high, before[1])
                self.open.updateValue((int(cell),), (low, high))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get() or (None,)
        ended = expiredTimerInfo.getExpiryTimeInMs() // (self.cell_s * 1000) - 1
        quiet = []
        closed = self.open.getValue((ended,))
        if closed is not None:
            low, high = closed
            self.open.removeKey((ended,))
            if last is not None and low - last > self.cell_s:
                quiet.append(last)
            last = high
            self.last.update((last,))
        if last is not None:
            deadline = last + self.cell_s
            following = self.open.getValue((last // self.cell_s + 1,))
            if following is None or following[0] > deadline:
                if timerValues.getCurrentWatermarkInMs() > deadline * 1000:
                    quiet.append(last)
                    self.last.clear()
                else:
                    self.handle.registerTimer(deadline * 1000 + 1)
        if quiet:
            yield pd.DataFrame({"asset_id": [key[0]] * len(quiet), "last_seen_s": quiet, "silent": [True] * len(quiet)})

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """State processors need the RocksDB store; a stream that has a checkpoint keeps the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def freshness_monitor(df: DataFrame, max_silence_s: int, ts: str = "timestamp_utc", delay: str = "0 seconds") -> DataFrame:
    """Stream of silence alerts: an asset without readings for more than ``max_silence_s``.

    Time is cut into cells as long as the silence allowed, so no silence lies
    inside a cell and only its first and last second matter, in whatever order
    and batches readings come within ``delay``. A timer at a cell's end hands
    its last second on; a silence is reported once the watermark has passed
    it, whether a reading follows or not. State is two numbers for each cell
    that the watermark has not passed, and one for each asset that is not
    silent. Readings without a time or asset are left out.
    """
    keep_state_on_disk(df.sparkSession)
    return (
        df.where(F.col("asset_id").isNotNull() & F.col(ts).isNotNull())
        .select("asset_id", ts)
        .withWatermark(ts, delay)
        .select("asset_id", ts, F.unix_seconds(ts).alias("seen_s"))
        .groupBy("asset_id")
        .transformWithStateInPandas(_Silence(max_silence_s), "asset_id string, last_seen_s long, silent boolean", "append", "eventTime")
    )


def request_alerts(
    logs: DataFrame, window: str = "5 minutes", slide: str = "1 minute", ts: str = "ts"
) -> DataFrame:
    """Error ratio and P95 latency per sliding window, with both alerts.

    Works on tables and, after ``withWatermark``, on streams. The P95 is exact
    on tables; on a stream it is approximate, and ``p95_is_exact`` says so.
    """
    p95 = (
        F.percentile_approx("latency_s", 0.95, 1000)
        if logs.isStreaming
        else F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_s)")
    )
    failed = F.col("status_code") >= 500
    return (
        logs.groupBy(F.window(ts, window, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(failed).alias("errors"),
            p95.alias("p95_latency_s"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "requests",
            "errors",
            "p95_latency_s",
            F.lit(not logs.isStreaming).alias("p95_is_exact"),
            (F.col("errors") / F.col("requests") > ERROR_RATIO).alias("error_alert"),
            (F.col("p95_latency_s") > LATENCY_P95_S).alias("latency_alert"),
        )
    )


def hourly_errors(logs: DataFrame, ts: str = "ts") -> DataFrame:
    """Server errors per hour."""
    return logs.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(
        F.count_if(F.col("status_code") >= 500).alias("errors")
    )


def _admit(at: np.ndarray, accepted: list[int], limit: int, span: int) -> tuple[list[int], list[int]]:
    """Places of the accepted ones among requests at the ascending times ``at``, and the accepted times to go on with.

    A request is accepted from the place on at which the ``limit``-th accepted time before it leaves the window, so
    the loop steps from one accepted request to the next, however many limited ones lie between.
    """
    if limit <= 0:
        return [], []
    leaves = lambda times: np.searchsorted(at, np.minimum(times, LAST_US - span) + span).tolist()
    after, taken, place = leaves(at), [], -1
    free = [0] * (limit - len(accepted)) + leaves(np.array(accepted, np.int64))
    for k in range(len(at)):
        place = max(place + 1, free[k])
        if place >= len(at):
            break
        taken.append(place)
        free.append(after[place])
    accepted = [*accepted, *at[taken[-limit:]].tolist()][-limit:]
    return taken, [a for a in accepted if a > int(at[-1]) - span]


def _decide(limit: int, window_s: float):
    """Flag requests in order; a row without a time brings the accepted times that the rows after it enter with.

    Each chunk ends with a row of the times it entered and leaves with, and of its first request. Rows without a state
    before them go on from the chunk before.
    """
    span = int(window_s * 1_000_000)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, entry, first, accepted = None, [], None, []
        schema = None
        for batch in batches:
            names = ("client", "_bucket", "request_id", "_us")
            clients, buckets, requests, times = (batch.column(c) for c in names)
            kinds = [*(batch.schema.field(c).type for c in names), pa.bool_(), *[pa.list_(pa.int64())] * 2]
            schema = pa.schema(list(zip([*names, "limited", "_entry", "_exit"], kinds, strict=True)))
            states = batch.column("_entry")
            opens = times.is_null().to_numpy(zero_copy_only=False)
            at, limited, ends = times.fill_null(0).to_numpy(), np.ones(len(times), bool), []
            begins = opens.copy()
            begins[:1] = True
            for key in (clients, buckets):
                begins[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(begins).tolist()
            for low, high in zip(begins, [*begins[1:], len(times)], strict=True):
                own = (clients[low].as_py(), buckets[low].as_py())
                if chunk != own:
                    if chunk is not None:
                        ends.append((*chunk, None, first, None, entry, accepted))
                    chunk, entry, first = own, accepted, None
                if opens[low]:
                    entry = accepted = states[low].as_py()
                    low += 1
                if low < high:
                    first = int(at[low]) if first is None else first
                    taken, accepted = _admit(at[low:high], accepted, limit, span)
                    limited[low:high][taken] = False
            blank = pa.nulls(len(times), kinds[-1])
            decided = pa.RecordBatch.from_arrays([clients, buckets, requests, times, pa.array(limited), blank, blank], schema=schema)
            yield decided.filter(pa.array(~opens))
            yield _batch(ends, schema)
        if chunk is not None:
            yield _batch([(*chunk, None, first, None, entry, accepted)], schema)

    return flag


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rate_flag(
    logs: DataFrame,
    limit: int = RATE_LIMIT,
    window_s: int = RATE_WINDOW_S,
    ts: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
    rounds: int = RATE_ROUNDS,
) -> DataFrame:
    """Requests (client, request_id, ts) with ``limited``.

    A request is limited when ``limit`` accepted requests of its client lie in
    the trailing window; limited requests do not count. The decision depends
    on all earlier ones, but only through the accepted times of the last
    window. A client's time line is cut into chunks of about ``chunk_rows``
    requests, and all chunks run at once from a guessed entry, no accepted
    times. Then each chunk's entry is compared with what its predecessor left
    with, and only chunks that differ run again, until none does. After a calm
    stretch (at most ``limit`` requests in two windows) a chunk leaves with the
    same times whatever it entered with, so changes stop there. A client whose
    chunks still differ after ``rounds``, or when a round has not halved the
    number of those that do, goes on in order from its first such chunk, in one
    task that streams its rows. Every chunk's last run counts.
    A request without a time or client is left out.
    """
    spark = logs.sparkSession
    known = logs.select("client", "request_id", ts).where(F.col(ts).isNotNull() & F.col("client").isNotNull())
    rows = materialize(
        place(known, ["client"], ts, chunk_rows).select("client", "_bucket", F.unix_micros(ts).alias("_us"), "request_id"), "requests"
    )
    key = ["client", "_bucket"]
    kind = logs.schema["client"].dataType.simpleString()
    number = logs.schema["request_id"].dataType.simpleString()
    none = F.array().cast("array<bigint>")

    def run(entries: DataFrame, turn: int, together: bool = False) -> DataFrame:
        """Decisions and exits of the chunks of ``entries``; a null entry goes on from the chunk before."""
        opens = entries.filter(F.col("_entry").isNotNull()).select(*key, "_entry")
        # requests carry an empty list: Arrow's writer takes time by the square of a run of null lists
        body = rows.join(entries.select(*key), key, "left_semi").withColumn("_entry", none).unionByName(opens, allowMissingColumns=True)
        by = ["client"] if together else key
        ordered = body.repartition(*by).sortWithinPartitions(*key, F.asc_nulls_first("_us"), "request_id")
        schema = f"client {kind}, _bucket bigint, request_id {number}, _us bigint, limited boolean, _entry array<bigint>, _exit array<bigint>"
        return materialize(ordered.mapInArrow(_decide(limit, window_s), schema).withColumn("_turn", F.lit(turn)), "decisions")

    done = [run(rows.select(*key).distinct().withColumn("_entry", none), 0)]
    exits = lambda part: part.filter(F.col("_exit").isNotNull()).select(*key, "_entry", "_exit", "_turn", F.col("_us").alias("_first"))
    states = exits(done[0])
    along = Window.partitionBy("client").orderBy("_bucket")
    before, last = None, False
    for turn in range(1, rounds + 2):
        # times out of the window of a chunk's first request decide nothing in it
        useful = F.filter(F.coalesce(F.lag("_exit").over(along), none), lambda at: at > F.col("_first") - window_s * 1_000_000)
        wanted = states.withColumn("_wanted", useful)
        differs = wanted.filter(F.col("_wanted") != F.col("_entry"))
        last = last or turn > rounds
        if last:
            # the first chunk that differs knows its entry for certain, as all before it agree
            first = differs.groupBy("client").agg(F.min_by(F.struct("_bucket", "_wanted"), "_bucket").alias("_f"))
            differs = states.join(first, "client").filter(F.col("_bucket") >= F.col("_f._bucket"))
            differs = differs.withColumn("_wanted", F.when(F.col("_bucket") == F.col("_f._bucket"), F.col("_f._wanted")))
        again = materialize(differs.select(*key, F.col("_wanted").alias("_entry")), "entries")
        differing = again.count()
        if not differing:
            break
        done.append(run(again, turn, last))
        fresh = exits(done[-1])
        states = materialize(states.join(fresh.select(*key), key, "left_anti").unionByName(fresh), "states")
        if last:
            break
        # a client that is always at its limit does not settle; more rounds would only repeat its chunks
        last, before = before is not None and 2 * differing > before, differing
    decided = done[0]
    for part in done[1:]:
        decided = decided.unionByName(part)
    if len(done) > 1:
        decided = decided.join(states.select(*key, "_turn"), [*key, "_turn"], "left_semi")
    return decided.filter(F.col("_exit").isNull()).select("client", "request_id", F.timestamp_micros("_us").alias(ts), "limited")


class _RateLimit(StatefulProcessor):
    """Requests of open cells of time, and the accepted times of the last window."""

    def __init__(self, limit: int, span_us: int, cell_ms: int):
        self.limit, self.span_us, self.cell_ms = limit, span_us, cell_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell long, part int", "us array<long>, request_id array<long>")
        self.accepted = handle.getListState("accepted", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows if key[0] is not None else ():
            batch = batch[batch["asks"]]
            for cell, part in batch.groupby(batch["us"] // (self.cell_ms * 1000)):
                number = sum(1 for _ in self._parts(int(cell)))
                self.waiting.updateValue((int(cell), number), (part["us"].tolist(), part["request_id"].tolist()))
                if not number:
                    self.handle.registerTimer((int(cell) + 1) * self.cell_ms)
        yield from ()

    def _parts(self, cell: int) -> Iterator[tuple[int, int]]:
        number = 0
        while self.waiting.containsKey((cell, number)):
            yield cell, number
            number += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end_ms = expiredTimerInfo.getExpiryTimeInMs()
        parts = list(self._parts(end_ms // self.cell_ms - 1))
        requests = sorted(request for part in parts for request in zip(*self.waiting.getValue(part), strict=True))
        for part in parts:
            self.waiting.removeKey(part)
        accepted = deque(sorted(at for (at,) in self.accepted.get()))
        limited = []
        for at, _ in requests:
            while accepted and accepted[0] <= at - self.span_us:
                accepted.popleft()
            limited.append(len(accepted) >= self.limit)
            if not limited[-1]:
                accepted.append(at)
        live = [(at,) for at in accepted if at > end_ms * 1000 - self.span_us]
        if live:
            self.accepted.put(live)
            # a timer after the window forgets a client that stays away
            self.handle.registerTimer(-(-(live[-1][0] + self.span_us) // (self.cell_ms * 1000)) * self.cell_ms)
        else:
            self.accepted.clear()
        if requests:
            times, ids = zip(*requests, strict=True)
            yield pd.DataFrame({"client": [key[0]] * len(times), "request_id": ids, "_us": times, "limited": limited})

    def close(self) -> None:
        pass


def rate_flag_stream(
    logs: DataFrame,
    limit: int = RATE_LIMIT,
    window_s: int = RATE_WINDOW_S,
    ts: str = "ts",
    delay: str = "1 minute",
    cell_s: int = RATE_WINDOW_S,
) -> DataFrame:
    """The same decision on a stream, in the order of request times.

    A request waits in the state until the watermark, which follows the newest
    request at ``delay``, has passed its cell of ``cell_s`` seconds. Cells are
    decided one after another by timers, so batches may overlap in time by up
    to ``delay`` and have any size; only one cell of a client is sorted at a
    time. State is the open cells' requests and at most ``limit`` accepted
    times of a client, which a timer removes after its window. A row without
    ``request_id`` moves the watermark and gets no decision, so a quiet stream
    can be closed by one; request ids are whole numbers. A request without a
    time or client is left out, and one behind the watermark gets no decision.
    """
    keep_state_on_disk(logs.sparkSession)
    return (
        logs.where(F.col(ts).isNotNull())
        .withWatermark(ts, delay)
        # a filter here would be moved below the watermark, which rows without a request must reach
        .select(
            "client",
            ts,
            F.col("request_id").isNotNull().alias("asks"),
            F.coalesce(F.col("request_id").cast("long"), F.lit(0)).alias("request_id"),
            F.unix_micros(ts).alias("us"),
        )
        .groupBy("client")
        .transformWithStateInPandas(
            _RateLimit(limit, int(window_s * 1_000_000), cell_s * 1000),
            "client string, request_id long, _us long, limited boolean",
            "append",
            "eventTime",
        )
    )
