"""Toxic spans and document scores from a linear-chain conditional random field.

*Labelled tokens.* Only documents carry labels. In a bounded sample of them a token is labelled toxic if its document
is and if one of its features (the word, its first four or five letters) occurs in toxic documents far more often than
in clean ones, by a likelihood ratio beyond what the number of features yields by chance.

*Field.* Two states, features of the word and its beginnings, and transitions, fitted to the labelled tokens by
gradient steps on the conditional likelihood with exact forward-backward expectations.

*Scores.* Forward-backward marginals give every token's probability to be toxic. Runs of likely tokens are the
offending spans; the strongest marginal, the expected number and the share of toxic tokens make the document's score
through a logistic curve fitted to the sample.

Forward and backward passes run over all documents of a piece at once: a document's first token has a transition that
forgets what was before, and the sequence is folded into blocks whose 2 x 2 products are chained.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.llm import arrays

#: Labelled documents that the model is fitted on: at most so many toxic and so many clean ones, and so many bytes of
#: each class, drawn by hash. Texts of more than ``TEXT_BYTES`` come after all others of their class, the shortest
#: first. The first text of a class is taken whatever its size, so both classes are there whenever labels hold both.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
SAMPLE_BYTES = 8 << 20
TEXT_BYTES = 64 << 10
#: Feature slots; features are hashed into them.
SLOTS = 1 << 18
#: Gradient steps, their size, and the pull of weights to zero.
ROUNDS, RATE, DECAY = 30, 0.4, 1e-6
#: Tokens of the sample that the field is fitted on, in whole documents; one that does not fit any more is passed over.
FIT_TOKENS = 600_000
#: Marginal from which a token belongs to a span.
LIKELY = 0.5
_STARTS = (4, 5)


@dataclass
class Model:
    weights: np.ndarray  # of feature slots, for the toxic state
    bias: float
    transition: np.ndarray  # log weights [from, to]; state 1 is toxic
    first: float  # log weight of starting in the toxic state
    curve: np.ndarray  # of the document score: intercept and three slopes


def features(data: np.ndarray, bounds: np.ndarray, hasher: arrays.SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature keys (tokens x 3), starts and ends of tokens, and the first token of each row."""
    starts, ends, first = arrays.word_spans(data, bounds, _WORDS)
    keys = np.empty((len(starts), 1 + len(_STARTS)), np.uint64)
    keys[:, 0] = hasher(data, starts, ends)
    for k, size in enumerate(_STARTS, 1):
        stop = np.minimum(starts + size, ends)
        # a beginning stops before a character that it would cut
        for _ in range(3):
            inner = (stop < ends) & ((data[np.minimum(stop, len(data) - 1)] & 0xC0) == 0x80)
            if not inner.any():
                break
            stop = stop + inner
        keys[:, k] = hasher(data, starts, stop) ^ np.uint64(0x5851F42D4C957F2D * k & (1 << 64) - 1)
    return keys, starts, ends, first


_FOLD = arrays.lower_table()
_WORDS = arrays.ALPHANUMERIC[_FOLD]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - 18)).astype(np.int64)


def passes(odds: np.ndarray, opens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state at every token.

    ``odds`` are the emission odds, ``opens`` marks first tokens of documents. Forward odds include the token's own
    emission, backward odds do not.
    """
    count = len(odds)
    if count == 0:
        return np.zeros(0), np.zeros(0)
    steps = max(1, int(np.sqrt(count)))
    blocks = -(-count // steps)
    size = steps * blocks
    (a00, a01), (a10, a11) = np.exp(model.transition)
    begin = np.exp(model.first)

    def folded(values: np.ndarray, rest: float) -> np.ndarray:
        full = np.full(size, rest)
        full[:count] = values
        return np.ascontiguousarray(full.reshape(blocks, steps).T)

    e = folded(odds, 1.0)
    new = folded(opens, True).astype(bool)
    # transition of each token: rows forget where a document opens
    t00, t10 = np.where(new, 1.0, a00), np.where(new, 1.0, a10)
    t01, t11 = np.where(new, begin, a01) * e, np.where(new, begin, a11) * e
    # product of each block, scaled
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for s in range(steps):
        p00, p01 = p00 * t00[s] + p01 * t10[s], p00 * t01[s] + p01 * t11[s]
        p10, p11 = p10 * t00[s] + p11 * t10[s], p10 * t01[s] + p11 * t11[s]
        scale = 1.0 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    before, after = np.empty(blocks), np.empty(blocks)
    odd = 1.0
    for b in range(blocks):
        before[b] = odd
        odd = (p01[b] + odd * p11[b]) / (p00[b] + odd * p10[b])
    odd = 1.0
    for b in range(blocks - 1, -1, -1):
        after[b] = odd
        odd = (p10[b] + odd * p11[b]) / (p00[b] + odd * p01[b])
    forward, backward = np.empty((steps, blocks)), np.empty((steps, blocks))
    odd = before
    for s in range(steps):
        odd = (t01[s] + odd * t11[s]) / (t00[s] + odd * t10[s])
        forward[s] = odd
    odd = after
    for s in range(steps - 1, -1, -1):
        backward[s] = odd
        odd = (t10[s] + odd * t11[s]) / (t00[s] + odd * t01[s])
    return forward.T.ravel()[:count], backward.T.ravel()[:count]


def _emission(keys: np.ndarray, model: Model) -> np.ndarray:
    return np.exp(np.clip(model.weights[_slots(keys)].sum(axis=1) + model.bias, -30, 30))


def marginals(keys: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Probability of every token to be toxic."""
    opens = np.zeros(len(keys), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    forward, backward = passes(_emission(keys, model), opens, model)
    both = forward * backward
    return both / (1 + both)


def _summaries(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: strongest marginal as log odds, expected number of likely tokens (log), and their share."""
    counts = np.diff(first)
    likely = np.concatenate(([0.0], np.cumsum(np.where(p >= LIKELY, p, 0.0))))
    expected = likely[first[1:]] - likely[first[:-1]]
    strongest = np.full(len(counts), 1e-4)
    able = counts > 0
    if able.any():
        strongest[able] = np.maximum.reduceat(p, first[:-1][able])
    strongest = np.clip(strongest, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(counts)), np.log(strongest / (1 - strongest)) / 4, np.log1p(expected), expected / np.maximum(counts, 1)], axis=1)


def _token_labels(keys: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the sample's tokens from the association of their features with toxic documents."""
    positives, negatives = int(toxic.sum()), int((~toxic).sum())
    marks = np.zeros(len(doc), bool)
    if not positives or not negatives:
        return marks
    for k in range(keys.shape[1]):
        distinct, inverse = np.unique(keys[:, k], return_inverse=True)
        once = np.unique(inverse.astype(np.int64) * len(toxic) + doc)
        slot, at = once // len(toxic), once % len(toxic)
        a = np.bincount(slot, weights=toxic[at], minlength=len(distinct))
        b = np.bincount(slot, minlength=len(distinct)) - a
        total = a + b
        share = positives / (positives + negatives)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (total * share)), 0) + np.where(b > 0, b * np.log(b / (total * (1 - share))), 0))
        purity = (a / positives) / (a / positives + b / negatives + 1e-12)
        strong = (ratio > 2 * np.log(max(len(distinct), 2)) + 4) & (purity > 0.95)
        marks |= strong[inverse]
    return marks & toxic[doc]


def _fit_field(keys: np.ndarray, opens: np.ndarray, labels: np.ndarray) -> Model:
    """Gradient ascent with per-weight step sizes."""
    slots = _slots(keys)
    model = Model(np.zeros(SLOTS), -2.0, np.zeros((2, 2)), -2.0, np.zeros(4))
    y = labels.astype(np.float64)
    inner = np.flatnonzero(~opens)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inner - 1].astype(int), labels[inner].astype(int)), 1)
    past, past_rest = np.full(SLOTS, 1e-3), np.full(6, 1e-3)
    for _ in range(ROUNDS):
        odds = np.exp(np.clip(model.weights[slots].sum(axis=1) + model.bias, -30, 30))
        forward, backward = passes(odds, opens, model)
        p = forward * backward / (1 + forward * backward)
        # expected transitions from the token before to each inner token
        left = forward[inner - 1]
        a = np.exp(model.transition)
        out = odds[inner] * backward[inner]
        w = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * out, left * a[1, 0], left * a[1, 1] * out])
        hoped = (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
        gap = y - p
        step = np.bincount(slots.ravel(), weights=np.repeat(gap, slots.shape[1]), minlength=SLOTS) - DECAY * model.weights * len(y)
        past += step**2
        model.weights += RATE * 3 * step / np.sqrt(past)
        rest = np.array([gap.sum(), gap[opens].sum(), *(seen - hoped).ravel()])
        past_rest += rest**2
        move = RATE * rest / np.sqrt(past_rest)
        model.bias += move[0]
        model.first += move[1]
        model.transition += move[2:].reshape(2, 2)
        model.transition = np.clip(model.transition, -8, 8)
    return model


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a weak prior."""
    w = np.zeros(x.shape[1])
    prior = 0.05 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (y - p) - prior @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fill(order: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Documents in ``order`` that fit into ``FIT_TOKENS`` one after another, and the least of each class in any case."""
    able = sizes > 0
    least = [int(own[np.argmin(sizes[own])]) for own in (np.flatnonzero(able & flags), np.flatnonzero(able & ~flags)) if len(own)]
    rest = FIT_TOKENS - int(sizes[least].sum())
    taken = set(least)
    for i in order.tolist():
        if i not in taken and sizes[i] <= rest:
            taken.add(i)
            rest -= int(sizes[i])
    return np.array([i for i in order.tolist() if i in taken], np.int64)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Model of a sample of whole texts with labels 0 and 1."""
    hasher = arrays.SpanHasher(_FOLD)
    found, sizes = [], []
    data, bounds = arrays.text_bytes(pa.array(texts, pa.large_string()))
    for _, _, part, edges in arrays.pieces(data, bounds):
        keys, _, _, first = features(part, edges, hasher)
        found.append(keys)
        sizes.append(np.diff(first))
    flags = np.array(toxic, bool)
    if not texts or flags.all() or not flags.any():
        share = (flags.sum() + 0.5) / (len(flags) + 1.0)
        return Model(np.zeros(SLOTS), -2.0, np.zeros((2, 2)), -2.0, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    per_piece = sizes
    keys, sizes = np.concatenate(found), np.concatenate(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    labels = _token_labels(keys, doc, flags)
    opens = np.zeros(len(keys), bool)
    opens[first[:-1][sizes > 0]] = True
    # toxic and clean documents by turns, whole, up to the bound
    order = np.argsort(np.where(flags, np.cumsum(flags) / max(flags.sum(), 1), np.cumsum(~flags) / max((~flags).sum(), 1)), kind="stable")
    taken = _fill(order, sizes, flags)
    at = arrays.ragged_positions(first[:-1][taken], sizes[taken])
    model = _fit_field(keys[at], opens[at], labels[at])
    # marginals of some documents at a time, as the passes hold several numbers for each token
    summaries = []
    for part, own in zip(found, per_piece, strict=True):
        edges = np.concatenate(([0], np.cumsum(own)))
        summaries.append(_summaries(marginals(part, edges, model), edges))
    model.curve = _fit_curve(np.concatenate(summaries), flags.astype(float))
    return model


def sample(docs: DataFrame, labels: DataFrame, train: Column, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """Bounded sample of labelled documents (``text``, ``label``, ``turn``), the first of each class by a hash of the id.

    Texts are ranked by their sizes and hashes alone and fetched afterwards, so no text is shuffled for the draw. Equal
    rows count once.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), train.alias("train")).where("text is not null")
    mark = F.xxhash64("text").alias("mark")
    sized = rows.where("train").select("id", mark, F.octet_length("text").cast("bigint").alias("bytes")).join(known, "id").distinct()
    over = F.when(F.col("bytes") > TEXT_BYTES, F.col("bytes")).otherwise(0)
    turned = sized.withColumns({"over": over, "turn": F.xxhash64(F.col("id").cast("string"))})
    order = ["over", "turn", "id", "mark"]
    drawn = [turned.where(F.col("label") == label).orderBy(*order).limit(most) for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    before = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn[0].unionByName(drawn[1]).withColumn("before", F.sum("bytes").over(before))
    bounded = sums.where(F.col("before").isNull() | (F.col("before") + F.col("bytes") <= SAMPLE_BYTES)).select("id", "mark", "label", "turn")
    # the drawn rows are bounded, so the texts stay where they are
    joined = rows.where("train").select("id", "text", mark).join(F.broadcast(bounded), ["id", "mark"])
    return joined.dropDuplicates(["id", "mark"]).select("text", F.col("label").cast("int").alias("label"), "turn")


def fit_sample(rows: DataFrame) -> Model:
    """Fit in one task, which the sample's bounds allow; the driver gets the model alone."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("text", "ascending")])
        model = fit(table.column("text").to_pylist(), table.column("label").to_pylist())
        used = np.flatnonzero(model.weights)
        parts = (used, model.weights[used], model.bias, model.transition, model.first, model.curve)
        return pa.table({"model": pa.array([pickle.dumps(parts)], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    if not found:
        return fit([], [])
    used, values, bias, transition, first, curve = pickle.loads(bytes(found[0]["model"]))
    weights = np.zeros(SLOTS)
    weights[used] = values
    return Model(weights, bias, transition, first, curve)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``score`` and ``spans`` of every whole text.

    Spans are runs of likely toxic tokens: start and end in characters and the strongest marginal. A null, empty or
    wordless text has the score that the curve gives to no evidence, and no spans. Repeated rows are scored each, an
    empty table gives an empty table, other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])
    packed = _packed(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(packed)
        hasher = arrays.SpanHasher(_FOLD)
        for batch in batches:
            data, bounds = arrays.text_bytes(batch.column(1))
            for begin, end, part, edges in arrays.pieces(data, bounds):
                keys, starts, ends, first = features(part, edges, hasher)
                p = marginals(keys, first, own)
                scores = _probability(p, first, own)
                spans: list[list[dict]] = [[] for _ in range(end - begin)]
                likely = np.flatnonzero(p >= LIKELY)
                if len(likely):
                    chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                    rows = np.searchsorted(first, likely, side="right") - 1
                    new = np.ones(len(likely), bool)
                    new[1:] = (np.diff(likely) > 1) | (np.diff(rows) > 0)
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(likely)) - 1
                    tops = np.maximum.reduceat(p[likely], heads)
                    origin = chars[edges[rows[heads]]]
                    for r, s, e, m in zip(
                        rows[heads].tolist(), (chars[starts[likely[heads]]] - origin).tolist(), (chars[ends[likely[tails]]] - origin).tolist(), tops.tolist(), strict=True
                    ):
                        spans[r].append({"start": s, "end": e, "marginal": m})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(scores), pa.array(spans, pa.list_(span))], ["id", "score", "spans"]
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text", limit: float = 0.5) -> DataFrame:
    """The whole rows of ``docs`` that score below ``limit``, filtered where they are read: nothing is shuffled.

    Columns stay as they are, whatever their names; nulls, repeated rows and empty tables as in :func:`score`.
    """
    packed = _packed(model)
    column = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(packed)
        hasher = arrays.SpanHasher(_FOLD)
        for batch in batches:
            data, bounds = arrays.text_bytes(batch.column(column).cast(pa.string()))
            for begin, end, part, edges in arrays.pieces(data, bounds):
                keys, _, _, first = features(part, edges, hasher)
                clean = _probability(marginals(keys, first, own), first, own) < limit
                yield batch.slice(begin, end - begin).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _packed(model: Model) -> tuple:
    """A model as it travels to the tasks: weights that are not zero, with four bytes each, and the rest."""
    used = np.flatnonzero(model.weights)
    return (used, model.weights[used].astype(np.float32)), (model.bias, model.transition, model.first, model.curve)


def _unpacked(packed: tuple) -> Model:
    weights = np.zeros(SLOTS)
    weights[packed[0][0]] = packed[0][1]
    return Model(weights, *packed[1])


def _probability(p: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Score of each document from the marginals of its tokens."""
    return 1 / (1 + np.exp(-np.clip(_summaries(p, first) @ model.curve, -30, 30)))


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never learned from: a fifth, by the checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on the labelled documents that are not held out."""
    return fit_sample(sample(docs, labels, ~held_out(id_column), id_column, text_column, label_column))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Fit on the labelled documents that are not held out, then score all."""
    return score(docs, learn(docs, labels, id_column, text_column, label_column), id_column, text_column)
