"""Exact top-k search by inner product with sequential reads of sorted lists only (no random access).

Candidates are dealt into blocks. In a block every dimension is a list sorted by value. A query reads the lists of its
positive weights from the top and those of its negative weights from the bottom, band by band. What it has read of a
candidate gives a partial score; with the best and the worst value still unread in the other lists that is an upper
and a lower bound. Reading stops when few candidates have an upper bound that reaches the k-th best lower bound;
for these the rest is read and the final scores are settled. Bounds of all queries of a block are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
#: Rows of a candidate block and of a query block, and parts in which a list is read.
BLOCK_ROWS = 8192
QUERY_ROWS = 512
BANDS = 8
#: Candidates of a query that are resolved instead of reading on.
RESOLVED = 32


#: Sums up to here are exact in 64-bit floats; beyond, bounds get a margin and finalists are settled in whole numbers.
EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def search_block(
    vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` candidates of each query among ``vectors``: query index, candidate index and score.

    ``copies`` counts the rows that a candidate stands for. The one with the query's own id and vector stands for one
    row less. Ties go to the smaller id; scores beyond 64 bits take the nearest bound.
    """
    rows, dims = vectors.shape
    most = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * dims
    kind = np.float32 if most < 2.0**24 else np.float64  # sums of integers are exact in both
    x, q = vectors.astype(kind), queries.astype(kind)
    margin = np.abs(q) @ np.abs(x).T * (dims + 4) * 2.0**-52 if most >= EXACT else None
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(rows)[:, None], axis=0)
    from_top = (rank * BANDS // max(rows, 1)).astype(np.int8)
    from_bottom = ((rows - 1 - rank) * BANDS // max(rows, 1)).astype(np.int8)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    # rows left of each candidate; a query's own row is none
    left = np.broadcast_to(copies, (len(q), rows)).copy()
    for i, j in zip(*np.nonzero(ids[None, :] == query_ids[:, None]), strict=True):
        left[i, j] -= bool((vectors[j] == queries[i]).all())
    partial = np.zeros((len(q), rows), kind)
    open_queries = np.arange(len(q))
    found: list[tuple[int, np.ndarray]] = []
    for band in range(BANDS):
        if len(open_queries) == 0:
            break
        part = partial[open_queries]
        part += up[open_queries] @ np.where(from_top == band, x, 0).T + down[open_queries] @ np.where(from_bottom == band, x, 0).T
        partial[open_queries] = part
        unread_top, unread_bottom = from_top > band, from_bottom > band
        last = band == BANDS - 1
        if last:
            low = high = part
        else:
            best_top = np.where(unread_top, x, -np.inf).max(axis=0)
            best_bottom = np.where(unread_bottom, x, np.inf).min(axis=0)
            best_top[~np.isfinite(best_top)] = 0
            best_bottom[~np.isfinite(best_bottom)] = 0
            a, b = unread_top.T.astype(kind), unread_bottom.T.astype(kind)
            high = part + (up[open_queries] * best_top) @ a + (down[open_queries] * best_bottom) @ b
            low = part + (up[open_queries] * x.min(axis=0)) @ a + (down[open_queries] * x.max(axis=0)) @ b
        if most >= EXACT:  # scores at a bound of 64 bits are ties
            low, high = (np.clip(b, _LEAST, _MOST) for b in (low - margin[open_queries], high + margin[open_queries]))
        own = left[open_queries] <= 0
        low = np.where(own, -np.inf, low)
        high = np.where(own, -np.inf, high)
        if rows > k:
            reach = np.partition(low, rows - k, axis=1)[:, rows - k]
        else:
            reach = np.full(len(open_queries), -np.inf)
        alive = (high >= reach[:, None]) & ~own
        few = alive.sum(axis=1)
        done = (few <= RESOLVED) if not last else np.ones(len(open_queries), bool)
        found += [(int(open_queries[i]), np.flatnonzero(alive[i])) for i in np.flatnonzero(done)]
        open_queries = open_queries[~done]
    out_query, out_row, out_score = [], [], []
    whole = object if most >= EXACT else np.int64
    for i, able in found:
        scores = vectors[able].astype(whole) @ queries[i].astype(whole)
        if whole is object:
            scores = np.array([min(max(s, _LEAST), _MOST) for s in scores], np.int64)
        first = np.lexsort((ids[able], ~scores))[:k]  # ~s orders as -s does, without an overflow
        often = np.minimum(left[i, able[first]], k)
        first = np.repeat(first, often)[:k]
        out_query.append(np.full(len(first), i))
        out_row.append(able[first])
        out_score.append(scores[first])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_query), np.concatenate(out_row), np.concatenate(out_score)


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row for each block and number of dimensions: distinct ids and vectors in order, and copies, as bytes."""

    def run(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, dims)
        both = np.column_stack((table.column("id").to_numpy().astype("<i8"), vectors))
        both, copies = np.unique(both, axis=0, return_counts=True)
        return pa.table(
            {
                "dims": pa.array([dims], pa.int32()),
                key: pa.array([table.column(key)[0].as_py()], pa.int32()),
                "ids": pa.array([both[:, 0].tobytes()], pa.binary()),
                "copies": pa.array([copies.astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([np.ascontiguousarray(both[:, 1:]).tobytes()], pa.binary()),
            }
        )

    return rows.groupBy("dims", key).applyInArrow(run, f"dims int, {key} int, ids binary, copies binary, vectors binary")


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of packs of queries that stream past the block before them; a block comes first of its rows."""
    held: dict = {}
    names = ["pack", "dims", "place", "query_id", "copies", "vec_id", "score"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, copies = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8")
            vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dims"])
            if row["pack"] is None:
                held = {"key": (row["dims"], row["block"]), "ids": ids, "copies": copies, "vectors": vectors}
            if row["pack"] is None or held.get("key") != (row["dims"], row["block"]):
                continue  # no candidate of that length is in the block
            at, found, scores = search_block(held["vectors"], held["ids"], held["copies"], vectors, ids, k)
            same = [pa.array(np.full(len(at), row[n]), pa.int32()) for n in ("pack", "dims")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), *map(pa.array, (ids[at], copies[at], held["ids"][found], scores))], names)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best candidates of every query row.

    Components become floor(``scale`` * x), at most the bounds of 64 bits; the score is the integer inner product,
    with the same bounds; ties go to the smaller id. Every row but the query's own is a candidate; vectors of other
    lengths are not. Rows with a null id, a null or empty vector, or a null or non-finite component take no part. Each
    row of a repeated id is a query and a candidate of its own: its ``k`` rows stand beside those of the other, and
    one may be a candidate of the other, also where both vectors agree. Empty tables give empty tables; other columns
    are ignored.
    """
    able = vectors.where(
        F.col(id_column).isNotNull()
        & F.col(vector_column).isNotNull()
        & (F.size(vector_column) > 0)
        & F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ).select(
        F.col(id_column).cast("long").alias("id"),
        F.transform(vector_column, lambda x: _whole(x.cast("double") * scale)).alias("v"),
        is_query.alias("asks"),
    )
    able = able.withColumn("dims", F.size("v"))
    sizes = able.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, packs = max(1, -(-sizes["n"] // BLOCK_ROWS)), max(1, -(-sizes["q"] // QUERY_ROWS))
    # equal rows meet in one block and one pack, so they are told apart by their number alone
    dealt = F.xxhash64("id", "v")
    candidates = _packed(able.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")).select("id", "v", "dims", "block"), "block")
    asked = able.where("asks").withColumn("pack", F.pmod(dealt, F.lit(packs)).cast("int")).select("id", "v", "dims", "pack")
    queries = _packed(asked, "pack").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a block is sent once, a query once for each block; neither is repeated for each pair
    met = candidates.withColumn("pack", F.lit(None).cast("int")).unionByName(queries).repartition("block").sortWithinPartitions("dims", "block", F.asc_nulls_first("pack"))
    schema = "pack int, dims int, place int, query_id bigint, copies bigint, vec_id bigint, score bigint"
    found = met.mapInArrow(lambda batches: _search(batches, k), schema)
    best = Window.partitionBy("dims", "pack", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # a query that stands for several equal rows answers for each of them
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def _whole(value: Column) -> Column:
    """Floor as a long, with the bounds of 64 bits beyond them."""
    top, bottom = F.lit(2.0**63), F.lit(-(2.0**63))
    return F.when(value >= top, F.lit(_MOST)).when(value <= bottom, F.lit(_LEAST)).otherwise(F.floor(value))
