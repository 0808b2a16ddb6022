"""Removal of long passages that repeat across documents, by run-length compressed Burrows-Wheeler indexes.

A passage counts when a string of ``span`` bytes also starts in a document with a smaller id. Equal strings have equal
least grams, so all windows of ``span`` bytes with one least gram meet in one bucket, wherever they are. The work is:

1. Documents are packed into chunks, which are written once; a chunk sends the hashes of its least grams, packed and
   sorted, and learns which of them occur in several documents and which very often.
2. Stretches of consecutive windows with one such gram go to its bucket, each distinct stretch of a chunk once. Windows
   of a very common gram go one by one to buckets by their own hash instead, so no gram fills a bucket.
3. A bucket builds a run-length index of its distinct stretches: runs of the Burrows-Wheeler transform of the order of
   ``span`` bytes, and the smallest document of a window where the windows before and after it do not simply move
   along one run. The stretches stream through it from right to left, all at once: one step of matching statistics
   bounded by ``span`` takes a window to the one before it, by a jump to the nearest run of the byte and its end.
4. Chunks mark the windows whose smallest document comes before their own, and cut their texts.

Only windows with a shared gram are indexed; grams that occur in one document cannot hold a repeated window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays, exchange
from voltmill.session import materialize, new_path

SPAN = 50
#: Text bytes of a chunk, of a range of grams and of a bucket of stretches.
CHUNK_BYTES, RANGE_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20, 8 << 20
#: Windows of a stretch; a longer one is cut.
WINDOWS = 128
#: Stretches of one gram in the whole corpus from which its windows go to buckets of their own.
COMMON = 1 << 14

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Positions whose grams are hashed at a time.
BLOCK = 1 << 15
#: Ends a string in an index; no byte of UTF-8.
_END = 255


def gram_bytes(span: int) -> int:
    """Bytes of a gram: about half a window, a multiple of eight."""
    return 8 * max(span // 16, 1)


def least_grams(data: np.ndarray, span: int) -> np.ndarray:
    """Least gram hash of the window that starts at each byte; the last ``span - 1`` bytes start none."""
    size, gram = len(data), gram_bytes(span)
    wanted = span - gram + 1
    padded = np.zeros(size + span + 8, np.uint8)
    padded[:size] = data
    words = np.ndarray((size + span,), "<u8", padded, strides=(1,))
    out = np.empty(size, np.uint64)
    for begin in range(0, size, BLOCK):  # blocks that stay in the processor's cache
        rows = min(BLOCK, size - begin)
        mixed = words[begin : begin + rows + span] * _STEP
        mixed ^= mixed >> np.uint64(32)
        mixed *= _STEP
        mixed ^= mixed >> np.uint64(29)
        hashes = mixed[: rows + wanted].copy()
        for k in range(8, gram, 8):
            hashes *= _STEP
            hashes += mixed[k : k + rows + wanted]
        width = 1
        while width < wanted:
            step = min(width, wanted - width)
            hashes = np.minimum(hashes[:-step], hashes[step:])
            width += step
        out[begin : begin + rows] = hashes[:rows]
    return out


class Stretches:
    """Consecutive windows of one least gram: first byte, windows, row and gram key; rows without an id have none."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, able: np.ndarray, span: int):
        # windows of a row are its first bytes
        stop = bounds[:-1] + np.where(able, np.maximum(np.diff(bounds) - span + 1, 0), 0)
        self.start = self.windows = self.row = np.zeros(0, np.int64)
        self.keys, self.key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if (stop == bounds[:-1]).all():
            return
        least = least_grams(data, span)
        change = np.ones(len(data), bool)
        np.not_equal(least[1:], least[:-1], out=change[1:])
        change[bounds[:-1][bounds[:-1] < len(data)]] = True
        opens = np.flatnonzero(change)
        rows = np.searchsorted(bounds, opens, side="right") - 1
        sizes = np.minimum(np.append(opens[1:], len(data)), stop[rows]) - opens
        used = sizes > 0
        opens, rows, sizes = opens[used], rows[used], sizes[used]
        parts = -(-sizes // WINDOWS)
        part = arrays.ragged_positions(np.zeros(len(sizes), np.int64), parts)
        self.start, self.row = np.repeat(opens, parts) + part * WINDOWS, np.repeat(rows, parts)
        self.windows = np.minimum(np.repeat(sizes, parts) - part * WINDOWS, WINDOWS)
        #: distinct gram keys, and the place of each stretch's own; mixed again, as least hashes are small ones
        keys = arrays.mix(least[opens]) >> np.uint64(64 - exchange.KEY_BITS)
        self.keys, self.key = np.unique(np.repeat(keys, parts), return_inverse=True)

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether several rows hold it, and its stretches, at most 65535."""
        order = _order(self.key.astype(np.uint64))
        last = np.cumsum(np.bincount(self.key, minlength=len(self.keys))) - 1
        first = np.concatenate(([0], last[:-1] + 1))
        rows = self.row[order]
        return rows[first] != rows[last], np.minimum(last - first + 1, 65535).astype(np.uint16)

    def sent(self, data: np.ndarray, shared: np.ndarray, common: np.ndarray, span: int, buckets: int) -> tuple[np.ndarray, ...]:
        """What goes to buckets: first byte, windows, row, and for each its place among the distinct strings; then of
        these, by bucket: first byte, windows and bucket."""
        able, often = shared[self.key], common[self.key]
        plain = np.flatnonzero(able & ~often)
        single = np.flatnonzero(able & often)
        start = np.concatenate((self.start[plain], arrays.ragged_positions(self.start[single], self.windows[single])))
        windows = np.concatenate((self.windows[plain], np.ones(int(self.windows[single].sum()), np.int64)))
        row = np.concatenate((self.row[plain], np.repeat(self.row[single], self.windows[single])))
        hashes = arrays.SpanHasher()(data, start, start + windows + span - 1)
        first, inverse = arrays.distinct_spans(data, start, start + windows + span - 1, hashes)
        spread = np.concatenate((arrays.mix(self.keys[self.key[plain]]), arrays.mix(hashes[len(plain) :])))
        bucket = (spread[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        first = first[order]
        return start, windows, row, place[inverse], start[first], windows[first], bucket[order]


def _order(values: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Stable order of numbers below 2^32, or ``order`` sorted further by them: one sort of numbers with their places."""
    if order is not None:
        values = values[order]
    places = np.sort(values << np.uint64(32) | np.arange(len(values), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    return places.astype(np.int64) if order is None else order[places]


def window_order(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``places`` by the ``depth`` bytes from there on, and where in it a new string begins.

    Eight bytes at a time; places that stand alone already are not looked at again.
    """
    padded = np.full(len(text) + depth + 8, _END, np.uint8)
    padded[: len(text)] = text
    words = np.ndarray((len(text) + depth,), ">u8", padded, strides=(1,))
    order, fresh = np.arange(len(places)), np.arange(len(places)) == 0
    for done in range(0, depth, 8):
        alone = fresh & np.append(fresh[1:], True)
        at = np.flatnonzero(~alone)
        own, group = order[at], np.cumsum(fresh)[at].astype(np.uint64)
        word = words[places[own] + done].astype(np.uint64) >> np.uint64(8 * max(8 - (depth - done), 0))
        high = word >> np.uint64(32)
        turned = _order(high, _order(word & np.uint64(0xFFFFFFFF)))
        if done:
            turned = _order(group, turned)
        order[at] = own[turned]
        group, word = group[turned], word[turned]
        fresh[at[1:]] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
    return order, fresh


class RunIndex:
    """Run-length index of strings for their windows of ``span`` bytes, with the smallest document of each.

    The transform has the byte before each window, and before the place after a string's last window, in the order of
    ``span`` bytes. Kept are its runs, the groups of equal windows, and samples of documents.
    """

    def __init__(self, strings: list[bytes], documents: np.ndarray, span: int):
        end = bytes([_END])
        sizes = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(end.join(strings) + end, np.uint8)
        self.span, self.text, self.stops = span, text, np.cumsum(sizes + 1) - 1
        self.windows = sizes - span + 1
        places = arrays.ragged_positions(self.stops - sizes, self.windows + 1)
        self.n = len(places)
        last = np.cumsum(self.windows + 1) - 1
        order, fresh = window_order(text, places, span)
        before = text[places[order] - 1]
        turns = np.concatenate(([True], before[1:] != before[:-1]))
        run, opens = np.cumsum(turns) - 1, np.flatnonzero(turns)
        lengths = np.diff(np.append(opens, self.n))
        by_symbol = _order(before[opens].astype(np.uint64))
        #: runs by symbol and place: symbol, place, length, and the window that the run's first symbol begins
        self.symbol, self.open, self.length = before[opens][by_symbol].astype(np.int64), opens[by_symbol], lengths[by_symbol]
        self.leads = np.cumsum(self.length) - self.length
        self.keys = self.symbol * (self.n + 1) + self.open
        group, self.begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        whole = np.ones(self.n, bool)
        whole[last] = False
        #: group of each window in order, and of each string's last one, where the stream enters
        self.group = group[whole[order]].astype(np.int32)
        at = np.empty(self.n, np.int32)
        at[order] = group
        self.entry = at[last - 1]
        # a group whose places stand in one run, and whose image is as large, hands its document on
        counts = np.diff(np.append(self.begin, self.n))
        own = run[self.begin]
        window = whole[order[self.begin]]
        hands = np.flatnonzero(window & (self.begin + counts <= opens[own] + lengths[own]) & (before[self.begin] != _END))
        leads = np.empty(len(opens), np.int64)
        leads[by_symbol] = self.leads
        image = self.group[leads[own[hands]] + self.begin[hands] - opens[own[hands]]]
        self.sampled = window
        self.sampled[image[counts[image] == counts[hands]]] = False
        self.sample_at = np.flatnonzero(self.sampled)
        self.sample = np.minimum.reduceat(np.repeat(documents, self.windows + 1)[order], self.begin)[self.sampled]

    def _document(self, groups: np.ndarray) -> np.ndarray:
        return self.sample[np.searchsorted(self.sample_at, groups)]

    def smallest(self) -> np.ndarray:
        """Smallest document with each window of each string, one string after another.

        All strings stream from their last window to the first in step. The byte before a window takes its group to the
        nearest run of that byte, and the run to the group of the window one byte earlier.
        """
        out = np.empty(int(self.windows.sum()), np.int64)
        bases = np.cumsum(self.windows) - self.windows
        order = np.argsort(-self.windows, kind="stable")
        stops, bases, sizes = self.stops[order], bases[order], self.windows[order] + self.span - 1
        group = self.entry[order]
        # no window follows a string's last one, so nothing is handed to it
        found = self._document(group)
        out[bases + sizes - self.span] = found
        for k in range(self.span + 1, int(sizes[0]) + 1 if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, side="right"))
            symbols = self.text[stops[:live] - k].astype(np.int64)
            place = self.begin[group[:live]]
            at = np.searchsorted(self.keys, symbols * (self.n + 1) + place, side="right") - 1
            inside = (at >= 0) & (self.symbol[at] == symbols) & (place < self.open[at] + self.length[at])
            at = np.where(inside, at, at + 1)
            group = self.group[self.leads[at] + np.where(inside, place - self.open[at], 0)]
            found = found[:live]
            fresh = self.sampled[group]
            found[fresh] = self._document(group[fresh])
            out[bases[:live] + sizes[:live] - k] = found
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, bounds = arrays.text_bytes(batch.column(1))
        for first, end, part, edges in arrays.pieces(data, bounds, CHUNK_BYTES):
            ids = pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), batch.column(0).slice(first, end - first))
            sizes = arrays.list_column(np.array([end - first]), np.diff(edges))
            text = zstandard.ZstdCompressor(level=1).compress(part)
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, sizes, arrays.binary_column([text]), pa.array([len(part)])], ["chunk", "ids", "sizes", "text", "bytes"])
            number += 1


def _opened(row: dict, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Stretches]:
    """Bytes, offsets, ids and stretches of a chunk; a null id is 0, and its row has no stretches."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))
    able = np.array([i is not None for i in row["ids"]], bool)
    ids = np.array([i or 0 for i in row["ids"]], np.int64)
    return data, bounds, ids, Stretches(data, bounds, able, span)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _ask(batches: Iterator[pa.RecordBatch], span: int, count: int) -> Iterator[pa.RecordBatch]:
    """Gram keys of each chunk, cut by range."""
    cuts = exchange.borders(count)
    for row in _rows(batches):
        stretches = _opened(row, span)[3]
        if len(stretches.keys) == 0:
            continue
        several, often = stretches.seen()
        at = np.searchsorted(stretches.keys, cuts)
        used = np.flatnonzero(at[1:] > at[:-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(np.full(len(used), row["chunk"])),
                arrays.binary_column([exchange.pack_sorted(stretches.keys[at[r] : at[r + 1]], int(cuts[r])) for r in used]),
                arrays.binary_column([np.packbits(several[at[r] : at[r + 1]]).tobytes() for r in used]),
                arrays.binary_column([exchange.pack(often[at[r] : at[r + 1]].astype(np.uint64)) for r in used]),
            ],
            ["part", "chunk", "keys", "several", "often"],
        )


def _answer(table: pa.Table, count: int) -> pa.Table:
    """Which keys of a range occur in several documents, and which of them very often."""
    part = table.column("part")[0].as_py()
    base = int(exchange.borders(count)[part])
    keys = [exchange.unpack_sorted(x.as_py(), base) for x in table.column("keys")]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)) for x, k in zip(table.column("several"), keys, strict=True)]
    often = np.concatenate([exchange.unpack(x.as_py()) for x in table.column("often")])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    chunks = np.bincount(inverse, minlength=len(distinct))
    shared = (chunks > 1) | (np.bincount(inverse, np.concatenate(several), len(distinct)) > 0)
    common = np.bincount(inverse, often, len(distinct)) >= COMMON
    stops = np.cumsum([len(k) for k in keys])[:-1]
    masks = [arrays.binary_column([np.packbits(x).tobytes() for x in np.split(m[inverse], stops)]) for m in (shared, common)]
    return pa.table([table.column("part"), table.column("chunk"), pa.array([len(k) for k in keys], pa.int32()), *masks], ["part", "chunk", "n", "shared", "common"])


def _sent(table: pa.Table, span: int, buckets: int) -> tuple:
    """A chunk's bytes, offsets, ids and what it sends to buckets, once its grams are answered."""
    (row,) = table.filter(table.column("text").is_valid()).to_pylist()
    data, bounds, ids, stretches = _opened(row, span)
    answers = table.filter(table.column("shared").is_valid()).sort_by("part").to_pylist()
    shared, common = (
        np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(a[m], np.uint8), count=a["n"]).astype(bool) for a in answers)]) for m in ("shared", "common")
    )
    return row, data, bounds, ids, stretches.sent(data, shared, common, span, buckets)


def _send(table: pa.Table, span: int, buckets: int) -> pa.Table:
    """The distinct stretches of one chunk for each bucket, with the smallest document of each."""
    row, data, _, ids, (start, windows, rows, place, first, sizes, bucket) = _sent(table, span, buckets)
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, place, ids[rows])
    used = np.unique(bucket)
    edges = np.append(np.searchsorted(bucket, used), len(bucket)).tolist()
    lengths = sizes + span - 1
    pack = zstandard.ZstdCompressor(level=1).compress
    texts = [pack(data[arrays.ragged_positions(first[a:b], lengths[a:b])].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "chunk": pa.array(np.full(len(used), row["chunk"])),
            "sizes": arrays.binary_column([sizes[a:b].astype(np.uint8).tobytes() for a, b in zip(edges, edges[1:], strict=False)]),
            "text": arrays.binary_column(texts),
            "documents": arrays.binary_column([smallest[a:b].astype("<i8").tobytes() for a, b in zip(edges, edges[1:], strict=False)]),
        }
    )


def _match(table: pa.Table, span: int) -> pa.Table:
    """For each chunk the smallest document of every window it sent to this bucket, as runs of equal ones."""
    place: dict[bytes, int] = {}
    asked, documents = [], []
    for sizes, text, own in zip(*(table.column(c).to_pylist() for c in ("sizes", "text", "documents")), strict=True):
        stops = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64) + span - 1).tolist()
        raw = zstandard.ZstdDecompressor().decompress(text)
        asked.append([place.setdefault(raw[a:b], len(place)) for a, b in zip([0, *stops], stops, strict=False)])
        documents.append(np.frombuffer(own, "<i8"))
    strings = list(place)
    smallest = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(smallest, np.concatenate([np.array(a, np.int64) for a in asked]), np.concatenate(documents))
    found = RunIndex(strings, smallest, span).smallest()
    windows = np.array([len(s) - span + 1 for s in strings], np.int64)
    bases = np.cumsum(windows) - windows
    values, counts = [], []
    for own in asked:
        own = np.array(own, np.int64)
        flat = found[arrays.ragged_positions(bases[own], windows[own])]
        opens = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        values.append(flat[opens].astype("<i8").tobytes())
        counts.append(exchange.pack(np.diff(np.append(opens, len(flat))).astype(np.uint64)))
    return pa.table([table.column("bucket"), table.column("chunk"), arrays.binary_column(values), arrays.binary_column(counts)], ["bucket", "chunk", "values", "counts"])


def _cut(table: pa.Table, span: int, buckets: int, kind: pa.DataType) -> pa.Table:
    """The documents of one chunk without the bytes of windows that an earlier document has."""
    found = table.filter(table.column("values").is_valid()).sort_by("bucket")
    row, data, bounds, ids, (start, windows, rows, place, _, sizes, _) = _sent(table, span, buckets)
    runs = [np.repeat(np.frombuffer(v, "<i8"), exchange.unpack(c).astype(np.int64)) for v, c in zip(found.column("values").to_pylist(), found.column("counts").to_pylist(), strict=True)]
    smallest = np.concatenate([np.zeros(0, np.int64), *runs])
    bases = np.cumsum(sizes) - sizes
    earlier = smallest[arrays.ragged_positions(bases[place], windows)] < np.repeat(ids[rows], windows)
    at = arrays.ragged_positions(start, windows)[earlier]
    change = np.bincount(at, minlength=len(data) + 1)[: len(data) + 1] - np.bincount(at + span, minlength=len(data) + 1)[: len(data) + 1]
    gone = np.cumsum(change)[: len(data)] > 0
    # maximal runs, which never cross a document
    lead = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    lead[bounds[:-1][bounds[:-1] < len(data)]] = False
    follow = np.concatenate((gone[1:], [False])) if len(gone) else gone
    follow[bounds[1:-1][bounds[1:-1] > 0] - 1] = False
    opens, stops = np.flatnonzero(gone & ~lead), np.flatnonzero(gone & ~follow) + 1
    owner = np.searchsorted(bounds, opens, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(opens - bounds[owner]), pa.array(stops - bounds[owner])], ["start", "end"])
    kept = np.concatenate(([0], np.cumsum(~gone)))[bounds]
    left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return pa.table(
        {
            "id": pa.array(row["ids"], kind),
            "n_bytes": pa.array(np.diff(bounds)),
            "spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
            "kept": left.cast(pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN) -> DataFrame:
    """``id_column``, ``n_bytes``, ``spans`` (removed runs: start and end in bytes) and ``kept`` (the rest) of every whole text.

    A byte goes if it lies in a string of ``span`` (16 or more) UTF-8 bytes that also starts in a document with a smaller
    id; all strings are judged on the input, and none crosses a document. ``kept`` may cut a character, so it is binary.
    Ids are whole numbers. Documents with one id, and so repeated rows, leave each other alone; so does a null id all
    others. A null, empty or short text loses nothing. A long text is one chunk of its own size; an empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    if span < 16:
        raise ValueError("span must be at least 16")
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType
    name = kind.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    layout = f"chunk bigint, ids array<{name}>, sizes array<bigint>, text binary, bytes bigint"
    path = new_path(spark, "chunks")
    # small row groups, as a row holds a whole chunk
    rows.mapInArrow(_chunks, layout).write.option("parquet.block.size", 16 << 20).parquet(path)
    chunks = spark.read.schema(layout).parquet(path)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    count, buckets = 1 + total // RANGE_BYTES, 1 + total // BUCKET_BYTES

    asked = chunks.mapInArrow(lambda batches: _ask(batches, span, count), "part int, chunk bigint, keys binary, several binary, often binary")
    masks = "part int, chunk bigint, n int, shared binary, common binary"
    answered = materialize(asked.groupBy("part").applyInArrow(lambda t: _answer(t, count), masks), "grams")
    joined = answered.unionByName(chunks.drop("bytes"), allowMissingColumns=True)
    sent = joined.groupBy("chunk").applyInArrow(lambda t: _send(t, span, buckets), "bucket int, chunk bigint, sizes binary, text binary, documents binary")
    found = sent.groupBy("bucket").applyInArrow(lambda t: _match(t, span), "bucket int, chunk bigint, values binary, counts binary")
    joined = joined.unionByName(found, allowMissingColumns=True)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[name]
    schema = f"id {name}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return joined.groupBy("chunk").applyInArrow(lambda t: _cut(t, span, buckets, arrow), schema).withColumnRenamed("id", id_column)
