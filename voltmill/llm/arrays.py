"""Texts as flat byte arrays: words, hashes and ragged gathers without a Python loop per word.

All functions work on the UTF-8 bytes of an Arrow string column. Word patterns that exclude only ASCII
characters are classes of bytes, because every byte of a multi-byte character is at least 0x80.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into 8-byte arrays at once; one longer text is a piece of its own.
PIECE_BYTES = 2 << 20

T = TypeVar("T")

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Masks of the lowest 0 to 8 bytes of a word.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def kept_by_worker(key: Hashable, make: Callable[[], T]) -> T:
    """An object that a Python worker builds once and later tasks of the same worker use again.

    Functions reach workers by value, so the globals of this module are new in each task; the object is kept beside
    the modules instead.
    """
    holder = sys.modules.setdefault("voltmill_worker_objects", types.ModuleType("voltmill_worker_objects"))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 bytes: all but the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(data: np.ndarray, bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut rows into runs of at most ``limit`` bytes (or one row): first row, end row, bytes, offsets."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        end = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of class bytes, and for each row the index of its first word.

    A run never crosses a row. The last array has one entry more than rows.
    """
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of byte spans, mixed eight bytes at a time.

    ``fold`` maps bytes before hashing (for example to lower case), so equal folded spans hash equally. Spans of equal
    length up to eight bytes never collide. A span beyond ``LONG`` bytes is digested as a whole.
    """

    LONG = 1024

    def __init__(self, fold: np.ndarray | None = None, seed: int = 7):
        self.fold = fold
        self.seed = np.uint64(seed)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data if self.fold is None else self.fold[data]
        blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        sizes = ends - starts
        state = mix(sizes.astype(np.uint64) * np.uint64(_MULTIPLIER) + self.seed)
        state = mix(state ^ (blocks[starts] & _LOW_BYTES[np.minimum(sizes, 8)]))
        left = np.flatnonzero((sizes > 8) & (sizes <= self.LONG))
        at = 8
        while len(left):
            state[left] = mix(state[left] ^ (blocks[starts[left] + at] & _LOW_BYTES[np.minimum(sizes[left] - at, 8)]))
            at += 8
            left = left[sizes[left] > at]
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=b"span")
            state[i] ^= np.uint64(int.from_bytes(digest.digest(), "little"))
        return state


def equal_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes[i]`` bytes at ``starts[i]`` and at ``others[i]`` are the same, for every i."""
    differs = data[ragged_positions(starts, sizes)] != data[ragged_positions(others, sizes)]
    upto = np.concatenate(([0], np.cumsum(differs)))
    stops = np.cumsum(sizes)
    return upto[stops] == upto[stops - sizes]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of spans that stand for all, and for each span the place of its like among them.

    A hash only proposes; a span whose bytes differ from those of its like stands for itself.
    """
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    sizes, likes = ends - starts, first[inverse]
    odd = sizes != sizes[likes]
    odd[~odd] = ~equal_spans(data, starts[~odd], starts[likes[~odd]], sizes[~odd])
    if odd.any():
        inverse[odd] = len(first) + np.arange(int(odd.sum()))
        first = np.concatenate((first, np.flatnonzero(odd)))
    return first, inverse


def ragged_positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after another."""
    total = int(counts.sum())
    shifts = starts - (np.cumsum(counts) - counts)
    return np.repeat(shifts, counts) + np.arange(total)


def list_column(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """Arrow list column with ``counts[i]`` values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
