"""Byte-level BPE encoding and decoding with exact merges.

A pretoken is encoded by backtracking over longest matches: an Aho-Corasick automaton over the vocabulary, with each
byte mapped to its Latin-1 character, gives the longest token that starts at every byte. A token is accepted when it
is compatible with the token before it, that is when merging the bytes of both gives exactly these two tokens; a
sequence whose neighbours are all compatible is the merge result. Compatibility is memoised, and a position found
hopeless is never tried again, so the work is linear in the length of the pretoken.

Each Python worker keeps the encodings of distinct pretokens and gathers them with array operations.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays, pretokens

#: Distinct pretokens, and adjacent pairs of tokens, that a worker remembers before it starts over.
MEMORY = 400_000

#: Ids decoded at once; one longer list is taken as a whole.
DECODED_IDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Exact merges of single pretokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        #: keys of pairs are (left + 1) * base + right, which are smaller than tuples
        self.base = max(ranks.values()) + 1
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.ends: dict[int, list[tuple[bytes, int, int]]] = {}
        self.heads: dict[int, list[tuple[bytes, int, int]]] = {}

    def merge(self, data: bytes, left: int = 1) -> list[int]:
        """Merges applied one at a time, lowest rank first, until ``left`` parts are left; used on single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > left:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _prefix(self, rank: int) -> int:
        """Longest token that is a proper prefix of a token; -1 if none is."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.tokens[rank]
            found = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)
            self.shorter[rank] = found
        return found

    def _spine(self, rank: int, right: bool) -> list[tuple[bytes, int, int]]:
        """Parts of a token at one of its edges while it is merged: bytes, rank of birth, rank of the merge that ends it.

        A token is born by the merge of its own rank, a byte with -1; the whole token has no end.
        """
        token, end, found = self.tokens[rank], 1 << 60, []
        while True:
            found.append((token, self.ranks[token] if len(token) > 1 else -1, end))
            if len(token) == 1:
                return found
            end = self.ranks[token]
            parts = self.merge(token, 2)
            token = self.tokens[parts[-1 if right else 0]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: start of the pretoken).

        It may not if, while both are merged, a part at the end of ``left`` and a part at the start of ``right`` exist
        together and would merge before either is used up; among equal ranks the leftmost merge comes first.
        """
        if left < 0:
            found = self.whole.get(right)
            if found is None:
                found = self.whole[right] = self.merge(self.tokens[right]) == [right]
            return found
        found = self.pairs.get((left + 1) * self.base + right)
        if found is None:
            ends = self.ends.get(left)
            if ends is None:
                ends = self.ends[left] = self._spine(left, True)
            heads = self.heads.get(right)
            if heads is None:
                heads = self.heads[right] = self._spine(right, False)
            rank_of, found = self.ranks.get, True
            for x, x_birth, x_end in ends:
                for y, y_birth, y_end in heads:
                    if x_birth <= y_end and y_birth < x_end:
                        rank = rank_of(x + y)
                        if rank is not None and rank < x_end and rank <= y_end:
                            found = False
                            break
                if not found:
                    break
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[(left + 1) * self.base + right] = found
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pretoken; a pretoken that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [-1] * (size + 1)
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - length] = rank  # ends ascend, so the longest comes last
        hopeless = bytearray(size + 1)
        sizes, pairs, shorter, base = self.sizes, self.pairs, self.shorter, self.base
        ids: list[int] = []
        at, token, left = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if not hopeless[end]:
                    fits = pairs.get((left + 1) * base + token)
                    if fits is None:
                        fits = self._fits(left, token)
                    if fits:
                        break
                found = shorter.get(token)
                token = self._prefix(token) if found is None else found
            if token >= 0:
                ids.append(token)
                at, left, token = end, token, longest[end]
            else:
                hopeless[at] = 1
                token = ids.pop()
                at -= sizes[token]
                left = ids[-1] if ids else -1
                found = shorter.get(token)
                token = self._prefix(token) if found is None else found
        return ids


class Gatherer:
    """Ids of whole texts from remembered encodings of their distinct pretokens."""

    def __init__(self, encode_many: Callable[[list[bytes]], Iterator[list[int]]], memory: int = MEMORY):
        self.encode_many = encode_many
        self.memory = memory
        self.hasher = arrays.SpanHasher()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = array("i")
        self.begins = array("q", [0])

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row, and the ids of all rows one after another."""
        starts = pretokens.pretoken_starts(data, bounds)
        if len(starts) == 0:
            return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.int32)
        ends = np.append(starts[1:], len(data))
        first, inverse = arrays.distinct_spans(data, starts, ends, self.hasher(data, starts, ends))
        if len(self.index) + len(first) > self.memory:
            self._clear()
        raw = data.tobytes()
        spans = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [span for span in dict.fromkeys(spans) if span not in self.index]
        for span, ids in zip(new, self.encode_many(new), strict=True):
            self.index[span] = len(self.begins) - 1
            self.flat.extend(ids)
            self.begins.append(len(self.flat))
        slots = np.fromiter(map(self.index.__getitem__, spans), np.int64, len(spans))[inverse]
        begins = np.array(self.begins, np.int64)
        counts = (begins[1:] - begins[:-1])[slots]
        ids = np.array(self.flat, np.int32)[arrays.ragged_positions(begins[slots], counts)]
        totals = np.concatenate(([0], np.cumsum(counts)))
        edges = totals[np.searchsorted(starts, bounds)]
        return np.diff(edges), ids


def _gatherer(vocabulary: str) -> Gatherer:
    encoder = Encoder(read_ranks(vocabulary))
    return Gatherer(lambda spans: map(encoder.encode, spans))


def _encode_batches(batches, vocabulary: str):
    gather = arrays.kept_by_worker(("bpe", vocabulary), lambda: _gatherer(vocabulary))
    for batch in batches:
        data, bounds = arrays.text_bytes(batch.column(1))
        for first, end, part, edges in arrays.pieces(data, bounds):
            counts, ids = gather(part, edges)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), arrays.list_column(counts, ids)], ["id", "ids"])


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every whole text: ``id_column`` and ``ids`` (array of int).

    ``vocabulary`` is a rank file that every executor can read; special tokens are ordinary text. A null or empty text
    has no ids. Rows are independent: repeated ids or texts give repeated rows, an empty table gives none, and other
    columns of ``docs`` are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        yield from _encode_batches(batches, vocabulary)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """Bytes of every list of ids: ``id_column``, ``ids`` and ``decoded`` (binary).

    A null list or a null id decodes to nothing; an id outside the vocabulary is an error.
    """
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches):
        ranks = read_ranks(vocabulary)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        begins = np.cumsum(lengths) - lengths
        known = np.zeros(size, bool)
        known[list(ranks.values())] = True
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            lists = batch.column(1)
            stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            bounds = np.concatenate(([0], stops))
            first = 0
            while first < len(lists):
                # some ids at a time, as positions of bytes take eight bytes each
                end = max(int(np.searchsorted(bounds, bounds[first] + DECODED_IDS, side="right")) - 1, first + 1)
                column = lists.slice(first, end - first)
                ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                present = ids >= 0
                if (ids < -1).any() or (ids[present] >= size).any() or not known[ids[present]].all():
                    raise ValueError("an id is not in the vocabulary")
                counts = np.where(present, lengths[np.maximum(ids, 0)], 0)
                data = flat[arrays.ragged_positions(begins[np.maximum(ids, 0)], counts)].tobytes()
                edges = np.concatenate(([0], np.cumsum(counts)))[bounds[first : end + 1] - bounds[first]].tolist()
                texts = [data[s:e] for s, e in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), column, arrays.binary_column(texts)], ["id", "ids", "decoded"])
                first = end

    rows = encoded.select(F.col(id_column).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_column)
