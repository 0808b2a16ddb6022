"""Bigram language model in Elias-Fano tries, one for each range of contexts.

Every chunk of documents sends its distinct bigrams with their training counts to the tasks that own their ranges of
keys (see :mod:`voltmill.llm.exchange`). Such a task sums them and builds its part of the model: a trie with the
contexts as first level, and the words that follow as second level, whose numbers start anew in every context. Both
levels and the pointers between them are monotone and kept as Elias-Fano sequences; the values are quantised
logarithms. The trie lies in a memory-mapped file, and all that chunks want to know is answered from it by successor
search, first for the context and then among its words.

A key is a 48-bit context and a 40-bit word, which travel as separate packed columns. A context is salted by four bits
of the word, so that the followers of a word that makes up a third of the corpus lie in sixteen ranges.

P(word | context) = (count(context, word) + mu P(word)) / (count(context) + mu), P(word) = (count + 1) / (N + V + 1).
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays, exchange
from voltmill.session import materialize

#: Weight of the unigram distribution, in counts.
MU = 4.0
#: Quantisation steps for a doubling of a count; codes are bytes.
STEPS = 8
CHUNK_BYTES = 8 << 20
#: Key of the token that ends every text; it is also the context of the first word.
_END = np.uint64(0xA0761D6478BD642F)
_HALF = exchange.KEY_BITS // 2
_LOW = np.uint64((1 << _HALF) - 1)
#: Bits of the word in a bigram key.
WORD_BITS = 40


class EliasFano:
    """Ascending numbers: low bits as byte planes, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> bytes:
        count = len(values)
        low_bits = max(0, int(bound // max(count, 1)).bit_length() - 1)
        low_bits += -low_bits % 8  # whole bytes
        values = values.astype(np.uint64)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(count + int(bound >> low_bits) + 2, np.uint8)
        unary[high + np.arange(count)] = 1
        planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, : low_bits // 8].T.tobytes()
        bits = np.packbits(unary).tobytes()
        return np.array([count, low_bits, len(unary)], "<i8").tobytes() + planes + bits

    def __init__(self, buffer, at: int):
        count, low_bits, length = np.frombuffer(buffer, "<i8", 3, at).tolist()
        at += 24
        width = low_bits // 8
        self.count, self.low_bits = count, low_bits
        self.planes = np.frombuffer(buffer, np.uint8, width * count, at).reshape(width, count)
        at += width * count
        packed = np.frombuffer(buffer, np.uint8, (length + 7) // 8, at)
        self.end = at + len(packed)
        zeros = np.flatnonzero(np.unpackbits(packed, count=length) == 0)
        #: numbers with high part h stand at first[h] .. first[h + 1] - 1
        self.first = np.concatenate(([0], zeros - np.arange(len(zeros))))

    def get(self, at: np.ndarray) -> np.ndarray:
        """Numbers at the given places."""
        high = np.searchsorted(self.first, at, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for k, plane in enumerate(self.planes):
            value |= plane[at].astype(np.uint64) << np.uint64(8 * k)
        return value

    def successor(self, wanted: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """First place in ``low .. high`` (default: all) with a number of at least ``wanted``; ``high`` if none.

        ``low`` and ``high`` bound runs inside which the numbers ascend; across runs they need not, if high parts
        carry the run (as the second level of the trie does).
        """
        part = np.minimum((wanted >> np.uint64(self.low_bits)).astype(np.int64), len(self.first) - 2)
        left, right = self.first[part], self.first[part + 1]
        if low is not None:
            left, right = np.maximum(left, low), np.minimum(right, high)
        target = wanted & np.uint64((1 << self.low_bits) - 1)
        left, right = left.copy(), np.maximum(right, left)
        while True:
            open_ = np.flatnonzero(left < right)
            if len(open_) == 0:
                return left
            middle = (left[open_] + right[open_]) // 2
            less = self._low(middle) < target[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(np.maximum(counts, 1)) * STEPS), 254).astype(np.uint8)


def build_trie(keys: np.ndarray, counts: np.ndarray, base: int, bound: int, words: np.ndarray | None = None) -> bytes:
    """Levels of the trie of ascending distinct (context, word) from context ``base`` to below ``bound``.

    Without ``words``, a key holds both halves, the word in the lower one.
    """
    if words is None:
        keys, words, base, bound = keys >> np.uint64(_HALF), keys & _LOW, base >> _HALF, bound >> _HALF
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    if len(heads) >= 1 << 64 - WORD_BITS:
        raise ValueError("too many contexts in one range; raise spark.sql.shuffle.partitions")
    # words of the i-th context follow those of the one before: i * 2^40 + word ascends over the whole level
    ordered = ((np.cumsum(new) - 1).astype(np.uint64) << np.uint64(WORD_BITS)) | words
    levels = [
        EliasFano.encode(keys[heads] - np.uint64(base), bound - base + 1),
        EliasFano.encode(np.append(heads, len(keys)), len(keys) + 1),
        EliasFano.encode(ordered, (len(heads) + 1) << WORD_BITS),
    ]
    return b"".join(levels) + quantise(counts).tobytes()


class Trie:
    """Part of the model in a memory-mapped file that vanishes with the task."""

    def __init__(self, data: bytes, base: int):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.base = base
        self.contexts = EliasFano(self.map, 0)
        self.pointers = EliasFano(self.map, self.contexts.end)
        self.words = EliasFano(self.map, self.pointers.end)
        self.values = np.frombuffer(self.map, np.uint8, self.words.count, self.words.end)

    def codes(self, keys: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Quantised value of each (context, word) plus one; 0 where it is not in the model. Keys as in :func:`build_trie`."""
        base = self.base
        if words is None:
            keys, words, base = keys >> np.uint64(_HALF), keys & _LOW, base >> _HALF
        wanted = keys - np.uint64(base)
        at = self.contexts.successor(wanted)
        found = at < self.contexts.count
        found[found] = self.contexts.get(at[found]) == wanted[found]
        context = at[found]
        begin = self.pointers.get(context).astype(np.int64)
        end = self.pointers.get(context + 1).astype(np.int64)
        word = (context.astype(np.uint64) << np.uint64(WORD_BITS)) | words[found]
        place = self.words.successor(word, begin, end)
        inside = place < end
        inside[inside] = self.words.get(place[inside]) == word[inside]
        codes = np.zeros(len(keys), np.uint8)
        codes[np.flatnonzero(found)[inside]] = self.values[place[inside]] + 1
        return codes


def ngrams(data: np.ndarray, bounds: np.ndarray, hasher: arrays.SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word key and context key of every token, with the end token of each row, and tokens per row."""
    starts, ends, first = arrays.word_spans(data, bounds, arrays.NON_SPACE)
    counts = np.diff(first) + 1
    token = np.insert(hasher(data, starts, ends), first[1:], _END)
    before = np.empty_like(token)
    before[0] = _END
    before[1:] = token[:-1]
    words = token >> np.uint64(64 - exchange.KEY_BITS)
    salt = token & np.uint64(15)
    contexts = arrays.mix(before * np.uint64(16) + salt + (before >> np.uint64(60))) >> np.uint64(64 - exchange.KEY_BITS)
    return words, contexts, counts


def _distinct(contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the place of each given pair among them."""
    order = np.lexsort((words, contexts))
    contexts, words = contexts[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return contexts[new], words[new], inverse


class _Chunk:
    """Distinct keys of a chunk, and the places of its tokens among them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hasher: arrays.SpanHasher):
        parts = [ngrams(d, e, hasher) for _, _, d, e in arrays.pieces(data, bounds)]
        words, contexts, self.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.words, self.word_of = np.unique(words, return_inverse=True)
        known, context_of = np.unique(contexts, return_inverse=True)
        # numbers inside the chunk sort like the keys that they stand for
        pairs = (context_of.astype(np.uint64) << np.uint64(32)) | self.word_of.astype(np.uint64)
        pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.contexts = known[(pairs >> np.uint64(32)).astype(np.int64)]
        self.followers = self.words[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)] >> np.uint64(exchange.KEY_BITS - WORD_BITS)

    def cuts(self, count: int) -> Iterator[tuple[int, int, int, int]]:
        """Part number, lower border, and places of the keys; bigrams are parts from 0, words from ``count``."""
        border = exchange.borders(count)
        for offset, keys in ((0, self.contexts), (count, self.words)):
            at = np.searchsorted(keys, border)
            for r in np.flatnonzero(at[1:] > at[:-1]).tolist():
                yield offset + r, int(border[r]), int(at[r]), int(at[r + 1])

    def asked(self, part: int, count: int, base: int, a: int, b: int) -> tuple[bytes, bytes, bytes]:
        """Keys of one cut: words; or contexts, each once, the number of their followers, and these."""
        if part >= count:
            return exchange.pack_sorted(self.words[a:b], base), b"", b""
        own, runs = np.unique(self.contexts[a:b], return_counts=True)
        return exchange.pack_sorted(own, base), exchange.pack(runs), exchange.pack(self.followers[a:b])


def _questions(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    hasher = arrays.SpanHasher(arrays.lower_table())
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, bounds = arrays.text_bytes(batch.column(1))
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, end, part, edges in arrays.pieces(data, bounds, CHUNK_BYTES):
            own = _Chunk(part, edges, hasher)
            learned = np.repeat(train[first:end], own.sizes)
            often = [np.bincount(of, weights=learned, minlength=len(keys)).astype(np.uint64) for of, keys in ((own.pair_of, own.contexts), (own.word_of, own.words))]
            rows = [(p, p, *own.asked(p, count, base, a, b), exchange.pack(often[p >= count][a:b])) for p, base, a, b in own.cuts(count)]
            key, number, *packed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(number, pa.int32()), *map(arrays.binary_column, packed)],
                ["key", "chunk", "part", "a", "runs", "followers", "b"],
            )
            chunk += 1


def _answer(table: pa.Table, count: int) -> pa.Table:
    """Sum the counts of one part, build its trie, and answer every chunk from it; words get their counts."""
    part = table.column("part")[0].as_py()
    border = exchange.borders(count)
    base, bound = int(border[part % count]), int(border[part % count + 1])
    asked = [exchange.unpack_sorted(x.as_py(), base) for x in table.column("a")]
    often = np.concatenate([exchange.unpack(x.as_py()) for x in table.column("b")])
    if part < count:
        asked = [np.repeat(x, exchange.unpack(r.as_py()).astype(np.int64)) for x, r in zip(asked, table.column("runs"), strict=True)]
        distinct, words, inverse = _distinct(np.concatenate(asked), np.concatenate([exchange.unpack(x.as_py()) for x in table.column("followers")]))
    else:
        distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, weights=often, minlength=len(distinct)).astype(np.uint64)
    known = total > 0
    stops = np.cumsum([len(x) for x in asked])
    if part >= count:
        answers = [exchange.pack(total[inverse[a:b]]) for a, b in zip([0, *stops], stops, strict=False)]
    elif known.any():
        trie = Trie(build_trie(distinct[known], total[known], base, bound, words[known]), base)
        codes = trie.codes(distinct, words)
        answers = [codes[inverse[a:b]].tobytes() for a, b in zip([0, *stops], stops, strict=False)]
    else:
        answers = [bytes(len(x)) for x in asked]
    known_words = int(known.sum()) if part >= count else 0
    tokens = int(total.sum()) if part >= count else 0
    rows = table.num_rows
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "part": table.column("part"),
            "a": arrays.binary_column(answers),
            "words": pa.array([known_words] + [0] * (rows - 1), pa.int64()),
            "tokens": pa.array([tokens] + [0] * (rows - 1), pa.int64()),
        }
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same chunks as :func:`_questions` cuts, with their texts packed."""
    import zstandard

    pressed = zstandard.ZstdCompressor(level=1)
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, bounds = arrays.text_bytes(batch.column(1))
        for first, end, part, edges in arrays.pieces(data, bounds, CHUNK_BYTES):
            ids = pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first)], ["id", "train"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()),
                    pa.array([-1], pa.int32()),
                    arrays.binary_column([pressed.compress(part.tobytes())]),
                    arrays.binary_column([edges.astype("<i8").tobytes()]),
                    arrays.binary_column([sink.getvalue().to_pybytes()]),
                ],
                ["chunk", "part", "a", "b", "c"],
            )
            chunk += 1


def _score(table: pa.Table, count: int, tokens: int, words: int, mu: float) -> pa.Table:
    """Scores of the documents of one chunk from its texts and answers."""
    import zstandard

    rows = table.to_pylist()
    (texts,) = [r for r in rows if r["part"] < 0]
    answers = {r["part"]: r["a"] for r in rows if r["part"] >= 0}
    edges = np.frombuffer(texts["b"], "<i8").astype(np.int64)
    size = int(edges[-1])
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts["a"], max_output_size=max(size, 1)), np.uint8)
    own = _Chunk(data, edges, arrays.SpanHasher(arrays.lower_table()))
    codes, counts = np.zeros(len(own.contexts), np.uint8), np.zeros(len(own.words), np.float64)
    for part, _, a, b in own.cuts(count):
        if part < count:
            codes[a:b] = np.frombuffer(answers.pop(part), np.uint8)
        else:
            counts[a:b] = exchange.unpack(answers.pop(part))
    if answers:
        raise RuntimeError("a chunk and its answers do not belong together")
    first = np.concatenate(([0], np.cumsum(own.sizes)))[:-1]
    token = counts[own.word_of]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    end = np.searchsorted(own.words, _END >> np.uint64(64 - exchange.KEY_BITS))
    context[first] = counts[end]
    code = codes[own.pair_of].astype(np.float64)
    pair = np.where(code > 0, np.exp2((code - 1) / STEPS), 0.0)
    plain = (token + 1) / (tokens + words + 1)
    smoothed = (np.minimum(pair, context) + mu * plain) / (context + mu)
    ids = pa.ipc.open_stream(texts["c"]).read_all()
    return pa.table(
        {
            "id": ids.column("id"),
            "held_out": pa.array(~ids.column("train").to_numpy(zero_copy_only=False).astype(bool)),
            "n_tokens": pa.array(own.sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((token > 0).astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(np.log10(plain), first)),
            "score": pa.array(np.add.reduceat(np.log10(smoothed), first)),
        }
    )


def score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = MU) -> DataFrame:
    """Log10 probability of every whole text, learned from the rows that are not ``held_out``.

    Columns: id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens with a training count),
    ``train_tokens``, ``base_score`` (unigrams with one added) and ``score`` (the bigram model). Words are runs without
    ASCII white space, A-Z lower-cased. A null or empty text is its end token. Repeated rows are learned and scored
    each; a null in ``held_out`` counts as false; without training rows all probabilities come from the added one; an
    empty table gives an empty table; other columns are ignored.

    The texts are written once, so that both passes see the same chunks whatever becomes of executors.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    count = exchange.ranges(spark)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        (~F.coalesce(held_out, F.lit(False))).alias("train"),
    )
    rows = materialize(rows, "texts")
    asked = rows.mapInArrow(lambda batches: _questions(batches, count), "key int, chunk bigint, part int, a binary, runs binary, followers binary, b binary")
    answered = asked.groupBy("key").applyInArrow(lambda t: _answer(t, count), "chunk bigint, part int, a binary, words bigint, tokens bigint")
    answered = materialize(answered, "answers")
    sums = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    tokens, words = sums["tokens"], sums["words"]
    texts = rows.mapInArrow(_texts, "chunk bigint, part int, a binary, b binary, c binary")
    none = F.lit(None).cast("binary")
    met = texts.unionByName(answered.select("chunk", "part", "a", none.alias("b"), none.alias("c")))
    scored = met.groupBy("chunk").applyInArrow(
        lambda t: _score(t, count, tokens, words, mu), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
