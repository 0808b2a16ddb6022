"""Maximal periodic runs of words by a suffix automaton whose suffix links are a link-cut tree.

Words are appended one after another. The states on the path from the new state to the root are the suffixes of what was
read; each carries the end of its last occurrence as a colour. One access walks the path by stretches of one colour and
recolours it. In a stretch that ends at a state of length L, a suffix of L words last ended d words ago; where d <= L it
closes a square of period d, and the stretch of words that it lies in is the run so far, as far left as it goes. The
previous end is the last one, so d is the smallest period.

Only zones of a text that can hold a run of the wanted size are read that way. All words of a run of period q, but for
its first q, begin a gram that occurred at most q words before. So a zone has enough consecutive grams that recur within
a power of two; the test is a sort of hashes, loses no run, and cuts a text only where no run can be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays

#: Smallest number of words of a run, and smallest number of its periods.
LENGTH, PERIODS = 6, 4
#: Words of a gram in the search for zones; less than the smallest run.
GRAM = 4


class SuffixPaths:
    """Suffix automaton of a growing sequence, its suffix links kept as a link-cut tree. State 0 is none, 1 the root."""

    def __init__(self):
        self.size, self.link, self.steps = [0, 0], [0, 0], [{}, {}]
        # splay trees of the paths of one colour: children, parent (of a tree's root: the state above the path), colour
        self.above, self.below, self.parent, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.words = 1, 0

    def _state(self, size: int, link: int, steps: dict) -> int:
        for column, value in ((self.size, size), (self.link, link), (self.steps, steps), (self.above, 0), (self.below, 0), (self.parent, link), (self.colour, -1)):
            column.append(value)
        return len(self.size) - 1

    def _splay(self, x: int) -> None:
        """Bring a state to the root of its tree, which hands it the colour of the path."""
        above, below, parent = self.above, self.below, self.parent
        root = x
        while True:
            f = parent[x]
            if not f or (above[f] != x and below[f] != x):
                break
            g = parent[f]
            inner = g and (above[g] == f or below[g] == f)
            root = g if inner else f
            turns = ((f, x),) if not inner else ((g, f), (f, x)) if (above[g] == f) == (above[f] == x) else ((f, x), (g, x))
            for up, down in turns:
                over = parent[up]
                if above[up] == down:
                    moved = above[up] = below[down]
                    below[down] = up
                else:
                    moved = below[up] = above[down]
                    above[down] = up
                if moved:
                    parent[moved] = up
                if over:
                    if above[over] == up:
                        above[over] = down
                    elif below[over] == up:
                        below[over] = down
                parent[down], parent[up] = over, down
        self.colour[x] = self.colour[root]

    def _split(self, state: int, above: int) -> int:
        """A copy of ``state`` for its strings of one word more than ``above``'s, put right above it on its path."""
        copy = self._state(self.size[above] + 1, self.link[state], self.steps[state].copy())
        self._splay(state)
        upper = self.above[state]
        self.above[copy], self.above[state], self.parent[copy] = upper, copy, state
        if upper:
            self.parent[upper] = copy
        self.link[state] = copy
        return copy

    def append(self, word: int) -> list[tuple[int, int]]:
        """Distance and length of every suffix class that closes a square with the new word."""
        steps, link, size = self.steps, self.link, self.size
        new = self._state(size[self.last] + 1, 0, {})
        p = self.last
        while p and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = steps[p][word]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                link[new] = copy = self._split(q, p)
                while p and steps[p].get(word) == q:
                    steps[p][word] = copy
                    p = link[p]
        self.parent[new] = link[new]
        self.last = new
        end, self.words = self.words, self.words + 1
        # access: every stretch of one colour on the way to the root, all of them one path afterwards
        squares = []
        lower, x = 0, new
        while x:
            self._splay(x)
            before = self.colour[x]
            if before >= 0 and end - before <= size[x]:
                squares.append((end - before, size[x]))
            cut = self.below[x]
            if cut:
                self.colour[cut] = before
            self.below[x] = lower
            lower, x = x, self.parent[x]
        self.colour[lower] = end
        return squares


def runs_of(words: Sequence[int], length: int = LENGTH, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every maximal run of at least ``length`` words and ``periods`` periods."""
    paths, ends = SuffixPaths(), {}
    for end, word in enumerate(words):
        for period, size in paths.append(word):
            ends[end - period - size + 1, period] = end
    found = ((start, end - start + 1, period) for (start, period), end in ends.items())
    return sorted((r for r in found if r[1] >= max(length, periods * r[2])), key=lambda r: (r[0], r[2]))


def zones(hashes: np.ndarray, first: np.ndarray, length: int = LENGTH, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """Row, first and end word of the stretches that together hold all runs; ``first`` has the first word of each row."""
    size = np.diff(first)
    count = np.maximum(size - GRAM + 1, 0)
    at = arrays.ragged_positions(first[:-1], count)
    if len(at) == 0:
        return []
    row = np.repeat(np.arange(len(size), dtype=np.uint64), count)
    keys = arrays.mix(row)
    for k in range(GRAM):
        keys = arrays.mix(keys ^ hashes[at + k])
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    later, earlier = order[1:][again], order[:-1][again]
    back = np.sort(later)
    distance = np.zeros(len(at), np.int64)
    distance[later] = at[later] - at[earlier]
    distance = distance[back]
    where = at[back]
    found = []
    level = 0
    while len(where) and (1 << level) <= 2 * int(size.max()):
        reach, least = 1 << level, (1 << level >> 1) + 1 if level else 1
        near = where[distance <= reach]
        if len(near):
            opens = np.flatnonzero(np.diff(near, prepend=-2) != 1)
            stops = np.append(opens[1:], len(near)) - 1
            # grams of a run of the level's smallest period that recur
            able = near[stops] - near[opens] + 1 >= max(length, periods * least) - GRAM + 1 - least
            begins, ends = near[opens][able] - reach, near[stops][able] + GRAM
            owner = np.searchsorted(first, near[opens][able], side="right") - 1
            found += zip(owner.tolist(), np.maximum(begins, first[owner]).tolist(), ends.tolist(), strict=True)
        level += 1
    merged: list[tuple[int, int, int]] = []
    for owner, begin, end in sorted(found):
        if merged and merged[-1][0] == owner and begin <= merged[-1][2]:
            merged[-1] = (owner, merged[-1][1], max(end, merged[-1][2]))
        else:
            merged.append((owner, begin, end))
    return merged


def _collapsed(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """The words of each row that are not dropped, with one blank between them."""
    out, keep = data.copy(), arrays.NON_SPACE[data]
    keep[arrays.ragged_positions(starts[dropped], (ends - starts)[dropped])] = False
    kept = np.flatnonzero(~dropped)
    owner = np.searchsorted(first, kept, side="right") - 1
    inner = kept[:-1][owner[:-1] == owner[1:]] if len(kept) else kept
    keep[ends[inner]] = True  # a word follows, so white space does
    out[ends[inner]] = 0x20
    offsets = np.concatenate(([0], np.cumsum(keep)))[bounds]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, periods: int = PERIODS) -> DataFrame:
    """``id_column``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every whole text.

    Words are runs without ASCII white space and compared exactly. A run is a stretch of words of smallest period
    ``period`` that no neighbour continues, of at least ``length`` words and ``periods`` (4 or more) periods.
    ``collapsed`` has the words that no run holds after its first period, with one blank between them. A null, empty or
    wordless text has no runs and collapses to nothing. A long text takes memory in proportion to the words of its
    zones. Repeated rows are read each, an empty table gives an empty table, other columns are ignored, whatever their
    names.
    """
    if length <= GRAM + 1 or periods < 3:
        raise ValueError(f"runs need more than {GRAM + 1} words and at least 3 periods")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = arrays.SpanHasher()
        for batch in batches:
            data, bounds = arrays.text_bytes(batch.column(1))
            for begin, end, part, edges in arrays.pieces(data, bounds):
                starts, ends, first = arrays.word_spans(part, edges, arrays.NON_SPACE)
                dropped = np.zeros(len(starts), bool)
                found: list[tuple[int, int, int, int]] = []
                raw = part.tobytes()
                for row, low, high in zones(hasher(part, starts, ends), first, length, periods):
                    numbers: dict[bytes, int] = {}
                    words = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    for start, size, period in runs_of(words, length, periods):
                        dropped[low + start + period : low + start + size] = True
                        found.append((row, low + start - int(first[row]), size, period))
                found.sort(key=lambda r: (r[0], r[1], r[3]))
                table = np.array(found, np.int64).reshape(-1, 4)
                offsets = np.searchsorted(table[:, 0], np.arange(end - begin + 1)).astype(np.int32)
                columns = [pa.array(np.ascontiguousarray(table[:, k])) for k in (1, 2, 3)]
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(np.diff(first).astype(np.int64)), runs, _collapsed(part, edges, starts, ends, first, dropped)],
                    ["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
