"""Isolation Forest (Liu, Ting and Zhou, 2008) over distributed rows.

Trees need small samples by design: ``trees`` samples of ``sample`` rows. Only
those rows are gathered, one task per tree. Scoring reads every row once, in
parallel, against the finished trees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmill.operators.quantiles import exact_quantiles
from voltmill.session import materialize

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def draw_samples(
    df: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """At most ``sample`` rows per tree, chosen by key hashes.

    A row is a candidate of each tree by a hash of its own, with twice the
    share that the sample needs; the others are dropped where they are read.
    Of the candidates the first ``sample`` by another hash are taken. The rule
    is the same at every size of the table.
    """
    rows = df.select(*key, *columns)
    total = rows.count()
    parts = [F.col(k) for k in key]
    share = min(1.0, 2.0 * sample / max(total, 1))
    unit = lambda tree: F.pmod(F.xxhash64(*parts, tree, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    able = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: unit(tree) < share)
    dealt = rows.withColumn("tree", F.explode(able))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(*parts, "tree", F.lit(seed + 2)), *parts)
    return (
        dealt.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= sample)
        .select("tree", "_rn", *columns)
    )


def _grow(columns: Sequence[str], sample: int, seed: int):
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        tree = int(pdf["tree"].iloc[0])
        points = pdf[list(columns)].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        pending = [(points, 0, -1, "")]
        while pending:
            rows, depth, parent, side = pending.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][4 if side == "left" else 5] = number
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_columns):
                nodes.append([tree, number, -1, 0.0, -1, -1, depth + average_path(len(rows))])
                continue
            feature = int(rng.choice(open_columns))
            threshold = float(rng.uniform(low[feature], high[feature]))
            goes_left = rows[:, feature] <= threshold
            nodes.append([tree, number, feature, threshold, -1, -1, 0.0])
            pending.append((rows[~goes_left], depth + 1, number, "right"))
            pending.append((rows[goes_left], depth + 1, number, "left"))
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"]
        )

    return grow


def fit_forest(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    trees: int = 100,
    sample: int = 256,
    seed: int = 20260728,
) -> DataFrame:
    """Node table of the forest, written once to the shared folder."""
    drawn = draw_samples(df, key, columns, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(_grow(columns, sample, seed), NODE_SCHEMA)
    return materialize(nodes, "isolation-nodes")


def _scorer(nodes: pd.DataFrame, sample: int):
    """Vectorized score of a batch; every tree is a set of flat arrays."""
    forest = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(
            tuple(tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length"))
        )
    scale = average_path(sample) or 1.0

    def score(*series: pd.Series) -> pd.Series:
        points = np.column_stack([s.to_numpy(dtype=float) for s in series])
        every = np.arange(len(points))
        lengths = np.zeros(len(points))
        for feature, threshold, left, right, length in forest:
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                here = every[inner]
                node = at[inner]
                goes_left = points[here, feature[node]] <= threshold[node]
                at[here] = np.where(goes_left, left[node], right[node])
            lengths += length[at]
        return pd.Series(np.power(2.0, -lengths / (len(forest) * scale)))

    return score


def isolation_forest(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.018,
    seed: int = 20260728,
) -> DataFrame:
    """Add ``anomaly_score`` and ``isolation_score`` (+1 outlier, -1 inlier).

    The node table has at most ``trees * (2 * sample - 1)`` rows whatever the
    size of ``df``, so it is carried to the tasks with the scoring function.
    """
    nodes = fit_forest(df, key, columns, trees, sample, seed).toPandas()
    used = int(min(sample, max(2, df.count())))
    score = F.pandas_udf(_scorer(nodes, used), T.DoubleType())
    scored = materialize(
        df.withColumn("anomaly_score", score(*[F.col(c) for c in columns])), "isolation-scores"
    )
    cut = exact_quantiles(scored, [], "anomaly_score", [1 - contamination]).select("quantile").scalar()
    return scored.withColumn(
        "isolation_score", F.when(F.col("anomaly_score") > cut, 1).otherwise(-1)
    )
