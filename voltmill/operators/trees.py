"""Regression trees grown level by level from histograms of gradients.

Features are cut into bins once. A level of a tree is one pass over the binned rows: each task adds up counts and gradients
per (tree, node, feature, bin) in arrays, Spark adds the cells of all tasks, and the best split of every node is found
from running sums over its bins. Cells can be added in any order, so rows are never gathered by node; the driver sees
the splits of a level, one row for each node, and nothing else.

Several trees grow in the same passes: all trees of a forest, or one tree of each of several boosted ensembles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmill.session import materialize

#: Most bins of a feature; a bin is one byte.
BINS = 64
#: Rounds after which the sums of all trees so far are written beside the rows.
KEPT_ROUNDS = 16
#: Relative error of the sketch behind a leaf's quantile is one in this many.
SKETCH = 2000


@dataclass
class Tree:
    """Nodes as arrays: feature, threshold bin (left takes it), children (-1: leaf) and value."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: Sequence[float]) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, cut
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for value in values:
            for column, start in ((self.feature, 0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value)):
                column.append(start)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.left, self.right, self.value))


def route(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Node that each row of bins ends in."""
    feature, cut, left, right, _ = tree
    node = np.zeros(len(bins), np.int64)
    inner = np.flatnonzero(left[node] >= 0)
    while len(inner):
        at = node[inner]
        node[inner] = np.where(bins[inner, feature[at]] <= cut[at], left[at], right[at])
        inner = inner[left[node[inner]] >= 0]
    return node


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of all bins but the last, per column: at most ``bins - 1`` values at even ranks."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    ranks = [k / bins for k in range(1, bins)]
    found = df.stat.approxQuantile(list(columns), ranks, 1 / (8 * bins))
    return [np.unique(np.array(f, dtype=float)) for f in found]


def binned(df: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], label: str, starts: Sequence[float]) -> DataFrame:
    """The table that trees are grown on: ``y``, ``x`` (a byte for each column) and ``f`` (sums so far), written once.

    A value belongs to the first bin whose edge it does not exceed. Rows with a null label or feature are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, len(edges) + 1)]
            cells = np.column_stack([np.searchsorted(e, v) for e, v in zip(edges, values, strict=True)]).astype(np.uint8)
            x = pa.Array.from_buffers(
                pa.binary(), len(cells), [None, pa.py_buffer((np.arange(len(cells) + 1) * len(edges)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells))]
            )
            f = np.tile(np.array(starts, float), len(cells))
            sums = pa.ListArray.from_arrays(pa.array((np.arange(len(cells) + 1) * len(starts)).astype(np.int32)), pa.array(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, sums], ["y", "x", "f"])

    rows = df.select(F.col(label).cast("double").alias("y"), *(F.col(c).cast("double") for c in columns)).dropna()
    return materialize(rows.mapInArrow(run, "y double, x binary, f array<double>"), "binned")


def _cells(batch: pa.RecordBatch, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, bins and sums of a batch."""
    y = batch.column(0).to_numpy(zero_copy_only=False)
    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, columns)
    return y, x, batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)


def _gradient(y: np.ndarray, f: np.ndarray, alpha: float | None) -> np.ndarray:
    """Of squared loss, or of pinball loss at ``alpha``."""
    return f - y if alpha is None else np.where(y >= f, -alpha, 1 - alpha)


def _sums(x: np.ndarray, f: np.ndarray, pending: Sequence[Sequence[tuple[np.ndarray, ...]]]) -> np.ndarray:
    """Sums of all trees: those written with the rows and those grown since, for each ensemble."""
    out = f.copy()
    for k, trees in enumerate(pending):
        for tree in trees:
            out[:, k] += tree[4][route(tree, x)]
    return out


def histograms(
    rows: DataFrame, columns: int, growing: Sequence[Tree], open_nodes: Sequence[Sequence[int]],
    pending: Sequence[Sequence[tuple[np.ndarray, ...]]], alphas: Sequence[float | None], bins: int = BINS,
) -> DataFrame:
    """Rows ``n`` and gradients ``g`` per (tree, node, feature, bin) of the open nodes.

    A task adds up in arrays whose size is that of the open nodes and sends the cells that hold rows. Tree ``t`` takes
    the gradient of ensemble ``t``; a forest has one ensemble for all its trees.
    """
    shapes = [t.arrays() for t in growing]
    places = [np.full(len(s[0]), -1) for s in shapes]
    for place, nodes in zip(places, open_nodes, strict=True):
        place[list(nodes)] = np.arange(len(nodes))
    alphas = list(alphas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(nodes) * columns * bins) for nodes in open_nodes]
        total = [np.zeros_like(c) for c in count]
        for batch in batches:
            y, x, f = _cells(batch, columns)
            sums = _sums(x, f, pending)
            gradients = [_gradient(y, sums[:, k], a) for k, a in enumerate(alphas)]
            for t, (shape, place) in enumerate(zip(shapes, places, strict=True)):
                slot = place[route(shape, x)]
                able = np.flatnonzero(slot >= 0)
                g = gradients[t if len(gradients) > 1 else 0][able]
                cell = (slot[able, None] * columns + np.arange(columns)) * bins + x[able]
                count[t] += np.bincount(cell.ravel(), minlength=len(count[t]))
                total[t] += np.bincount(cell.ravel(), np.repeat(g, columns), len(count[t]))
        for t, nodes in enumerate(open_nodes):
            used = np.flatnonzero(count[t])
            node = np.array(nodes, np.int32)[used // (columns * bins)] if len(used) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), t, np.int32)),
                    pa.array(node),
                    pa.array((used // bins % columns).astype(np.int32)),
                    pa.array((used % bins).astype(np.int32)),
                    pa.array(count[t][used].astype(np.int64)),
                    pa.array(total[t][used]),
                ],
                ["tree", "node", "feature", "bin", "n", "g"],
            )

    cells = rows.mapInArrow(run, "tree int, node int, feature int, bin int, n bigint, g double")
    # tasks have added up their rows already; dealt by feature, neither the sum nor the search for splits moves cells again
    dealt = cells.repartition("tree", "node", "feature")
    return dealt.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))


def best_splits(
    cells: DataFrame, min_leaf: int = 1, l2: float = 0.0, seed: int | None = None, share: float = 1.0, keys: Sequence[str] = ("tree", "node")
) -> DataFrame:
    """The split of largest gain of every node: feature, bin, gain, and rows and gradients of both sides.

    Without a ``seed`` every bin is a possible cut. With one, each feature of a node offers a single random bin between
    its least and its greatest, and only a random ``share`` of the features does. Ties go to the smaller feature, then
    bin. A node that cannot be split has a null feature; its totals stand on the left.
    """
    keys = list(keys)
    one = Window.partitionBy(*keys, "feature")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumns({"nl": F.sum("n").over(upto), "gl": F.sum("g").over(upto), "na": F.sum("n").over(one), "ga": F.sum("g").over(one)})
    run = run.withColumns({"nr": F.col("na") - F.col("nl"), "gr": F.col("ga") - F.col("gl")})
    able: Column = F.least("nl", "nr") >= max(min_leaf, 1)
    if seed is not None:
        draw = F.pmod(F.xxhash64(F.lit(seed), *keys, "feature"), F.lit(1 << 30)) / (1 << 30)
        low, high = F.min("bin").over(one), F.max("bin").over(one)
        run = run.withColumns({"cut": low + F.floor(draw * (high - low)), "after": F.lead("bin").over(one.orderBy("bin"))})
        # the cut falls on or after this bin and before the next one that holds rows
        able = able & (F.col("bin") <= F.col("cut")) & (F.col("cut") < F.coalesce("after", F.lit(1 << 20)))
        if share < 1:
            luck = F.pmod(F.xxhash64(F.lit(seed + 1), *keys, "feature"), F.lit(1 << 30)) / (1 << 30)
            able = able & (luck < share)
    score = lambda g, n: F.col(g) * F.col(g) / (F.col(n) + l2)
    gain = F.when(able, score("gl", "nl") + score("gr", "nr") - score("ga", "na"))
    best = F.max_by(F.struct("feature", "bin", "gain", "nl", "gl", "nr", "gr"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    first = F.max(F.struct("na", "ga"))
    found = run.withColumn("gain", gain).groupBy(*keys).agg(best.alias("s"), first.alias("a"))
    split = F.col("s.gain") > 1e-12
    side = lambda own, whole: F.when(split, F.col(f"s.{own}")).otherwise(F.col(f"a.{whole}")).alias(own)
    return found.select(
        *keys,
        *(F.when(split, F.col(f"s.{c}")).alias(c) for c in ("feature", "bin", "gain")),
        side("nl", "na"),
        side("gl", "ga"),
        *(F.when(split, F.col(f"s.{c}")).alias(c) for c in ("nr", "gr")),
    )


def _grow(
    rows: DataFrame, columns: int, trees: int, pending: list, alphas: Sequence[float | None], depth: int, leaves: int | None,
    min_leaf: int, l2: float, bins: int, seed: int | None = None, share: float = 1.0,
) -> list[Tree]:
    """Grow trees by at most ``depth`` levels; of a level, splits of larger gain come first until ``leaves`` is reached."""
    grown = [Tree() for _ in range(trees)]
    nodes: list[list[int]] = [[0] for _ in grown]
    value = lambda g, n: -g / (n + l2) if n else 0.0
    for level in range(depth):
        if not any(nodes):
            break
        cells = histograms(rows, columns, grown, nodes, pending, alphas, bins)
        found = best_splits(cells, min_leaf, l2, None if seed is None else seed + level, share).collect()
        nodes = [[] for _ in grown]
        for s in sorted(found, key=lambda s: (s.tree, -(s.gain or 0.0), s.node)):
            tree = grown[s.tree]
            if s.node == 0:
                whole = (s.gl + (s.gr or 0.0), s.nl + (s.nr or 0))
                tree.value[0] = value(*whole)
            if s.feature is None or (leaves is not None and sum(c < 0 for c in tree.left) >= leaves):
                continue
            left, right = tree.split(s.node, s.feature, s.bin, (value(s.gl, s.nl), value(s.gr, s.nr)))
            nodes[s.tree] += [n for n, c in ((left, s.nl), (right, s.nr)) if c >= 2 * min_leaf]
    return grown


def first_splits(df: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], label: str, levels: int, min_leaf: int = 1, l2: float = 0.0) -> DataFrame:
    """Splits of the first levels of one tree: ``level``, ``node``, ``feature``, ``bin``, ``gain`` and rows and label sums of both sides."""
    rows = binned(df, columns, edges, label, [0.0])
    width = max(len(e) for e in edges) + 1
    tree, nodes, parts = Tree(), [0], []
    for level in range(levels):
        cells = histograms(rows, len(columns), [tree], [nodes], [[]], [None], width)
        found = materialize(best_splits(cells, min_leaf, l2).where("feature IS NOT NULL"), "splits")
        parts.append(found.withColumn("level", F.lit(level)))
        splits = found.orderBy("node").collect()
        nodes = [n for s in splits for n in tree.split(s.node, s.feature, s.bin, (0.0, 0.0))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = F.array(*map(F.lit, columns))[F.col("feature")].alias("feature")
    return out.select("level", "node", names, "bin", "gain", "nl", "nr", (-F.col("gl")).alias("yl"), (-F.col("gr")).alias("yr"))


def _leaf_quantiles(rows: DataFrame, columns: int, grown: list[Tree], pending: list, alphas: Sequence[float]) -> None:
    """Replace leaf values by the quantile of what is left to explain in the leaf."""
    shapes = [t.arrays() for t in grown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x, f = _cells(batch, columns)
            sums = _sums(x, f, pending)
            for t, shape in enumerate(shapes):
                leaf = route(shape, x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), t, np.int32)), pa.array(leaf), pa.array(y - sums[:, t])], ["tree", "leaf", "rest"])

    rest = rows.mapInArrow(run, "tree int, leaf int, rest double")
    probs = sorted(set(alphas))
    found = rest.groupBy("tree", "leaf").agg(F.percentile_approx("rest", F.array(*map(F.lit, probs)), SKETCH).alias("q")).collect()
    for r in found:
        grown[r.tree].value[r.leaf] = r.q[probs.index(alphas[r.tree])]


def _as_model(trees: Sequence[Tree], edges: Sequence[np.ndarray], weights: np.ndarray, base: float) -> dict:
    """Trees on values instead of bins, as plain arrays."""
    out = []
    for tree in trees:
        feature, cut, left, right, value = tree.arrays()
        threshold = np.array([edges[f][min(b, len(edges[f]) - 1)] if c >= 0 else 0.0 for f, b, c in zip(feature, cut, left, strict=True)])
        out.append({"feature": feature, "threshold": threshold, "left": left, "right": right, "value": value})
    return {"kind": "trees", "trees": out, "weights": weights, "base": base}


def boost(
    train: DataFrame, columns: Sequence[str], label: str, rounds: int, rate: float, leaves: int | None = 24, depth: int = 8,
    min_leaf: int = 20, l2: float = 0.0, alphas: Sequence[float | None] = (None,), bins: int = BINS,
) -> list[dict]:
    """Gradient boosting on histograms: one model for each of ``alphas`` (None: squared loss, else pinball loss).

    The ensembles grow side by side, so a level of all of them is one pass. A leaf of pinball loss holds the quantile
    of what is left there. Every ``KEPT_ROUNDS`` rounds the sums are written beside the rows. An empty table gives
    models of zero.
    """
    alphas = list(alphas)
    edges = bin_edges(train, columns, bins)
    known = train.where(F.col(label).isNotNull())
    probs = [a for a in alphas if a is not None]
    first = known.agg(F.avg(label).alias("m"), F.percentile_approx(label, F.array(*map(F.lit, probs or [0.5])), SKETCH).alias("q")).first()
    if first.m is None:
        return [_as_model([], edges, np.zeros(0), 0.0) for _ in alphas]
    bases = [float(first.m if a is None else first.q[probs.index(a)]) for a in alphas]
    rows = binned(known, columns, edges, label, bases)
    width = max(len(e) for e in edges) + 1
    pending: list[list] = [[] for _ in alphas]
    done: list[list[Tree]] = [[] for _ in alphas]
    for r in range(rounds):
        grown = _grow(rows, len(columns), len(alphas), pending, alphas, depth, leaves, min_leaf, l2, width)
        if probs:
            _leaf_quantiles(rows, len(columns), grown, pending, alphas)
        for k, tree in enumerate(grown):
            tree.value = [rate * v for v in tree.value]
            done[k].append(tree)
            pending[k].append(tree.arrays())
        if (r + 1) % KEPT_ROUNDS == 0 and r + 1 < rounds:
            rows, pending = _with_sums(rows, len(columns), pending), [[] for _ in alphas]
    return [_as_model(trees, edges, np.ones(len(trees)), base) for trees, base in zip(done, bases, strict=True)]


def _with_sums(rows: DataFrame, columns: int, pending: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, f = _cells(batch, columns)
            sums = _sums(x, f, pending)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(sums) + 1) * sums.shape[1]).astype(np.int32)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["y", "x", "f"])

    return materialize(rows.mapInArrow(run, rows.schema), "sums")


def extra_trees(
    train: DataFrame, columns: Sequence[str], label: str, trees: int, depth: int, min_leaf: int = 3, share: float = 0.8,
    seed: int = 0, bins: int = BINS,
) -> dict:
    """Extremely randomised trees on all rows: random cuts, the best of a random share of the features.

    All trees grow in the same passes, one for each level. An empty table gives a model of zero.
    """
    edges = bin_edges(train, columns, bins)
    known = train.where(F.col(label).isNotNull())
    if known.isEmpty():
        return _as_model([], edges, np.zeros(0), 0.0)
    rows = binned(known, columns, edges, label, [0.0])
    width = max(len(e) for e in edges) + 1
    grown = _grow(rows, len(columns), trees, [[]], [None], depth, None, min_leaf, 0.0, width, seed, share)
    return _as_model(grown, edges, np.full(trees, 1 / trees), 0.0)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Predictions of rows of feature values."""
    total, every = np.full(len(x), float(model["base"])), np.arange(len(x))
    for weight, tree in zip(model["weights"], model["trees"], strict=True):
        node = np.zeros(len(x), np.int64)
        inner = every[tree["left"][node] >= 0]
        while len(inner):
            at = node[inner]
            node[inner] = np.where(x[inner, tree["feature"][at]] <= tree["threshold"][at], tree["left"][at], tree["right"][at])
            inner = inner[tree["left"][node[inner]] >= 0]
        total += weight * tree["value"][node]
    return total


def with_predictions(df: DataFrame, models: dict[str, dict], columns: Sequence[str]) -> DataFrame:
    """``df`` with a column for each named model; ``columns`` are its features and must not be null."""
    names = list(models)

    @F.pandas_udf("array<double>")
    def score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        return pd.Series(list(np.column_stack([predict(models[n], x) for n in names])))

    scored = df.withColumn("_predictions", score(*(F.col(c).cast("double") for c in columns)))
    return scored.withColumns({n: F.col("_predictions")[i] for i, n in enumerate(names)}).drop("_predictions")
