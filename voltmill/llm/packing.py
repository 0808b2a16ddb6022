"""Best-fit packing with large-item matching.

A sequence holds ``capacity`` tokens. Pieces above a third of it are large: at most two fit together, so they are
matched greedily, the longest first, each with the longest partner that still fits. Smaller pieces then go, longest
first, into the tightest gap that holds them, and into new sequences where none does.

The plan needs only the number of pieces of each length. All pieces of one length are interchangeable, so whole runs
of equal sequences are filled at once, and the plan is bounded by the capacity, however many documents there are.
Spark counts the lengths, numbers the pieces of each length, and looks each (length, number) up in the plan.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmill.llm import arrays
from voltmill.llm.bpe import Gatherer
from voltmill.session import materialize

CAPACITY = 2048
#: Numbering runs inside this many parts of each length, so that a hot length is no single task.
PARTS = 256


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first number, count, first sequence, offset)`` of ``counts[length]`` pieces.

    Piece ``first number + i`` of a length goes to sequence ``first sequence + i`` at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    placed: list[tuple[int, int, int, int, int]] = []
    next_number = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, count)
    order: list[int] = []  # free spaces in use, ascending
    sequences = 0

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        placed.append((length, next_number[length], count, sequence, offset))
        next_number[length] += count
        left[length] -= count

    def free(space: int, sequence: int, count: int) -> None:
        if space and count:
            if space not in gaps:
                gaps[space] = []
                insort(order, space)
            gaps[space].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        if at < 0:
            count, used = left[longest], longest
            put(longest, count, sequences, 0)
        else:
            mate = large[at]
            if mate == longest:
                count = left[longest] // 2 or 1
            else:
                count = min(left[longest], left[mate])
            single = mate == longest and left[longest] == 1
            put(longest, count, sequences, 0)
            used = longest
            if not single:
                put(mate, count, sequences, longest)
                used += mate
        free(capacity - used, sequences, count)
        sequences += count
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                count = max(left[length] // each, 1)
                fill = min(each, left[length])
                for k in range(fill):
                    put(length, count, sequences, k * length)
                free(capacity - fill * length, sequences, count)
                sequences += count
                continue
            space = order[at]
            sequence, room = gaps[space].pop()
            if not gaps[space]:
                del gaps[space]
                order.pop(at)
            count = min(room, left[length])
            put(length, count, sequence, capacity - space)
            free(space - length, sequence, count)
            free(space, sequence + count, room - count)
    return placed


def _number(pieces: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_number``: a gapless order of the pieces of each length, taken in parts of bounded size."""
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("length", "_part", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy(*keys)
    return (
        pieces.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_part"])
        .withColumn("_number", F.col("_before") + F.col("_rank"))
        .drop("_before", "_rank", "_part")
    )


def place(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``length`` (1 to ``capacity``).

    ``keys`` should identify a row; rows that agree in all of them are interchangeable. Rows without a length, or with
    one outside the range, are an error. An empty table gives an empty table. Column names other than ``keys`` and
    ``length`` are free except for those added here and ``_part``, ``_rank``, ``_before``, ``_number``.
    """
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
    lengths = materialize(parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("pieces")), "length-counts")
    counts = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.sum("pieces").alias("n")).limit(capacity + 2).collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    steps = sorted(plan(counts, capacity))
    span = np.int64(1) << np.int64(44)
    starts = np.array([s[0] * span + s[1] for s in steps], np.int64)
    first = np.array([s[3] for s in steps], np.int64)
    offset = np.array([s[4] for s in steps], np.int64)
    names = [*pieces.columns, "sequence_id", "offset"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            key = columns["length"].to_numpy(zero_copy_only=False).astype(np.int64) * span
            key += columns["_number"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, key, side="right") - 1
            columns["sequence_id"] = pa.array(first[at] + key - starts[at])
            columns["offset"] = pa.array(offset[at])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    numbered = _number(parted, lengths, keys)
    return numbered.mapInArrow(look_up, f"{schema}, sequence_id bigint, offset bigint")


def _vocabulary_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a byte-level vocabulary in tokenizers' JSON, as bytes with their ids; the ids are the merge order."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    # the library shows bytes as printable characters: printable Latin-1 as itself, the others from U+0100 on
    printable = [b for b in range(256) if chr(b) in ByteLevel.alphabet()]
    hidden = [b for b in range(256) if b not in printable]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(map(shown.__getitem__, token)): rank for token, rank in tokenizer.get_vocab().items() if token not in special}


def _added_tokens(path: str) -> dict[bytes, int]:
    """Tokens that tokenizers cuts out of a text before it is split into words, with their ids."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError(f"{path} has added tokens that depend on their surroundings")
    return {t.content.encode(): number for number, t in added.items()}


class AroundTokens:
    """Ids of whole texts in which the literals of ``added`` stand for one id each; ``gather`` takes the text between."""

    def __init__(self, gather: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], added: dict[bytes, int]):
        self.gather = gather
        self.added = added
        # the leftmost literal counts, and the longest of those
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if self.pattern else b""
        if not self.pattern or not self.pattern.search(raw):
            return self.gather(data, bounds)
        stops = bounds.tolist()
        hits = [m for a, b in zip(stops[:-1], stops[1:], strict=True) for m in self.pattern.finditer(raw, a, b)]
        starts = np.array([m.start() for m in hits], np.int64)
        ends = np.array([m.end() for m in hits], np.int64)
        own = np.array([self.added[m[0]] for m in hits], np.int32)
        edges = np.unique(np.concatenate([np.asarray(bounds, np.int64), starts, ends]))
        counts, flat = self.gather(data, edges.astype(bounds.dtype))
        # a literal's stretch gives its one id instead of what its characters gave
        literal = np.searchsorted(edges, starts)
        keep = np.ones(len(counts), bool)
        keep[literal] = False
        between = flat[np.repeat(keep, counts)]
        counts = np.where(keep, counts, 0)
        flat = np.insert(between, np.cumsum(counts)[literal], own)
        counts[literal] = 1
        totals = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(totals[np.searchsorted(edges, bounds)]), flat


def _tokenizer_gatherer(vocabulary: str) -> AroundTokens:
    """Distinct pretokens are merged by tiktoken, many times as fast as one tokenizers call for each."""
    import tiktoken

    ranks = _vocabulary_ranks(vocabulary)
    merge = tiktoken.Encoding("packing", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return AroundTokens(Gatherer(lambda spans: map(merge, spans)), _added_tokens(vocabulary))


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of every whole document: id, ``piece``, ``start``, ``length`` and ``ids``.

    A document is its ids, in which a literal of an added token is that token's id, and ``end_id``; a null or empty text is ``end_id`` alone. Only a document longer than
    ``capacity`` is cut, into pieces of ``capacity``, of which the first takes what is left over.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = arrays.kept_by_worker(("tokenizers", vocabulary), lambda: _tokenizer_gatherer(vocabulary))
        for batch in batches:
            data, bounds = arrays.text_bytes(batch.column(1))
            for first, end, part, edges in arrays.pieces(data, bounds):
                counts, flat = gather(part, edges)
                stops = np.cumsum(counts)
                ids = np.insert(flat, stops, end_id)
                sizes = counts + 1
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), number)
                piece = arrays.ragged_positions(np.zeros(len(sizes), np.int64), number)
                short = (sizes - (number - 1) * capacity)[row]
                length = np.where(piece == 0, short, capacity)
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(length), arrays.list_column(length, ids)],
                    ["id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {kind}, piece bigint, start bigint, length bigint, ids array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def checksums(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    names = [c for c in pieces.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            lists = columns["ids"]
            values = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            ends = (np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * 4).tolist()
            sums = [zlib.crc32(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names] + [pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    return pieces.mapInArrow(run, f"{schema}, ids_crc32 bigint")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``, as :func:`cut` and :func:`place` define.

    Returns id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``. Repeated rows are
    packed as often as they come; rows with a null id are packed like others; other columns are ignored. The digests
    of the pieces are written once to the shared folder, so texts are encoded once; the ids themselves come from
    :func:`cut`.
    """
    pieces = materialize(checksums(cut(docs, vocabulary, capacity, end_id, id_column, text_column)), "pieces")
    return place(pieces, [id_column, "piece", "ids_crc32"], capacity)
