"""Size-aware heavy-light Jaccard join on word shingles.

1. *Shared shingles.* Every chunk of documents asks the dictionary (see :mod:`voltmill.llm.exchange`) which of its
   shingles occur in other documents. A document of n shingles of which fewer than the threshold's share are shared
   links with nothing and leaves the join here. Shared shingles get numbers that sort by frequency, rarest first.
2. *Classes.* Documents with equal sets are one class and are joined once.
3. *Candidates.* Linked sets of sizes a and b share at least ``need(max(a, b))`` shingles, so among the
   ``n - need(n) + k`` rarest shingles of each they share k. Light sets, up to a boundary size, emit all subsets of
   k = 2 of these; heavy sets, and light ones that are near enough in size to link with a heavy one, enter the
   inverted lists of single shingles (k = 1), which heavy sets scan. The boundary is the size with the least cost:
   subsets emitted by the light sets plus list entries read for the others.
4. *Links.* First each class is compared with the head of each of its lists, the class with the most frequent shingles
   (what many were copied from); the links found make components. Then, in every list that still holds several components, each class outside the largest one is compared
   with all classes of other components. Pairs of which too few shingles remain behind the key are left out in both
   rounds; a linked pair passes in the list of its first common shingles. So a list of a million mutual near copies
   costs a million comparisons, and every pair that can link is inside one component already or compared.

Comparisons are exact intersections of the shared shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays, exchange
from voltmill.llm.components import components
from voltmill.session import materialize

WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 80
#: Text bytes of a chunk.
CHUNK_BYTES = 8 << 20

#: Cost of sending a list entry, and of looking at one that shares the list.
EMIT_COST, READ_COST = 1.0, 0.02

_STEP = 0xC2B2AE3D27D4EB4F


def shingles(data: np.ndarray, bounds: np.ndarray, hasher: arrays.SpanHasher, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle keys of each row, one row after another, and their number per row."""
    starts, ends, first = arrays.word_spans(data, bounds, arrays.NON_SPACE)
    hashes = hasher(data, starts, ends)
    size = np.diff(first)
    count = np.where(size >= words, size - words + 1, size > 0).astype(np.int64)
    at = arrays.ragged_positions(first[:-1], count)
    width = np.repeat(np.minimum(size, words), count)
    total = np.zeros(len(at), np.uint64)
    for k in range(words):
        here = np.minimum(at + k, len(hashes) - 1)
        total += np.where(k < width, hashes[here], np.uint64(0)) * np.uint64(pow(_STEP, k + 1, 1 << 64))
    keys = arrays.mix(total + width.astype(np.uint64)) >> np.uint64(64 - exchange.KEY_BITS)
    edges = np.concatenate(([0], np.cumsum(count)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        keys[a:b].sort()
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    keep[edges[:-1][count > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))[edges]
    return keys[keep], np.diff(kept)


def _questions(batches: Iterator[pa.RecordBatch], count: int, words: int) -> Iterator[pa.RecordBatch]:
    """For each chunk: its distinct keys cut at the borders, and each document's positions among them.

    Every document gets a number of its own, ``row``: the partition in the upper bits, a running count in the lower.
    """
    hasher = arrays.SpanHasher(arrays.lower_table())
    cuts = exchange.borders(count)
    chunk = TaskContext.get().partitionId() << 32
    row = TaskContext.get().partitionId() << 40
    names = ["key", "chunk", "part", "row", "id", "n", "a", "b"]
    for batch in batches:
        data, bounds = arrays.text_bytes(batch.column(1))
        for first, end, part, edges in arrays.pieces(data, bounds, CHUNK_BYTES):
            found = [shingles(d, e, hasher, words) for _, _, d, e in arrays.pieces(part, edges)]
            keys, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
            distinct, inverse, often = np.unique(keys, return_inverse=True, return_counts=True)
            often = np.minimum(often, 255).astype(np.uint8)
            at = np.searchsorted(distinct, cuts)
            used = np.flatnonzero(at[1:] > at[:-1])
            asked = [exchange.pack_sorted(distinct[at[r] : at[r + 1]], int(cuts[r])) for r in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array(np.full(len(used), chunk)),
                    pa.array(used, pa.int32()),
                    pa.nulls(len(used), pa.int64()),
                    pa.nulls(len(used), batch.column(0).type),
                    pa.array(at[used + 1] - at[used], pa.int64()),
                    arrays.binary_column(asked),
                    arrays.binary_column([often[at[r] : at[r + 1]].tobytes() for r in used]),
                ],
                names,
            )
            stops = np.cumsum(sizes).tolist()
            places = [exchange.pack_sorted(inverse[a:b]) for a, b in zip([0, *stops], stops, strict=False)]
            rows = end - first
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, chunk % count), pa.int32()),
                    pa.array(np.full(rows, chunk)),
                    pa.array(np.full(rows, -1), pa.int32()),
                    pa.array(np.arange(row, row + rows)),
                    batch.column(0).slice(first, rows),
                    pa.array(sizes, pa.int64()),
                    arrays.binary_column(places),
                    arrays.binary_column([b""] * rows),
                ],
                names,
            )
            chunk += 1
            row += rows


def _answer(table: pa.Table, count: int) -> pa.Table:
    """For the cuts of one key range: which keys occur in several documents, and in how many.

    Rows of documents pass through.
    """
    table = table.drop_columns(["key"])
    parts = table.column("part").to_numpy()
    asked = table.filter(pa.array(parts >= 0))
    passed = table.filter(pa.array(parts < 0)).append_column("c", pa.nulls(int((parts < 0).sum()), pa.binary()))
    if asked.num_rows == 0:
        return passed
    base = int(exchange.borders(count)[asked.column("part")[0].as_py()])
    keys = [exchange.unpack_sorted(x.as_py(), base) for x in asked.column("a")]
    often = np.frombuffer(b"".join(x.as_py() for x in asked.column("b")), np.uint8)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.minimum(np.bincount(inverse, weights=often, minlength=len(distinct)), 32767).astype(np.uint64)[inverse]
    masks, shared, totals, at = [], [], [], 0
    for own in keys:
        mine = total[at : at + len(own)]
        at += len(own)
        mask = mine >= 2
        masks.append(np.packbits(mask).tobytes())
        shared.append(exchange.pack_sorted(own[mask], base))
        totals.append(exchange.pack(mine[mask]))
    columns = {n: asked.column(n) for n in ("chunk", "part", "row", "id", "n")}
    columns |= {"a": arrays.binary_column(masks), "b": arrays.binary_column(shared), "c": arrays.binary_column(totals)}
    return pa.concat_tables([passed, pa.table(columns).select(passed.column_names).cast(passed.schema)])


def _shared(table: pa.Table, count: int, threshold: int) -> pa.Table:
    """Documents of one chunk with their shared shingles, rarest first; none if too few are shared."""
    parts = table.column("part").to_numpy()
    answers = table.filter(pa.array(parts >= 0)).sort_by("part")
    docs = table.filter(pa.array(parts < 0))
    cuts = exchange.borders(count)
    masks, tokens = [], []
    for part, n, a, b, c in zip(*(answers.column(x).to_pylist() for x in ("part", "n", "a", "b", "c")), strict=True):
        masks.append(np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool))
        tokens.append(exchange.unpack(c) << np.uint64(exchange.KEY_BITS) | exchange.unpack_sorted(b, int(cuts[part])))
    mask = np.concatenate([*masks, np.zeros(0, bool)])
    token = np.zeros(len(mask), np.uint64)
    token[mask] = np.concatenate([*tokens, np.zeros(0, np.uint64)])
    lists = []
    for n, places in zip(docs.column("n").to_pylist(), docs.column("a").to_pylist(), strict=True):
        own = token[exchange.unpack_sorted(places).astype(np.int64)]
        own = own[own > 0]
        lists.append(np.sort(own).astype(np.int64) if n and 100 * len(own) >= threshold * n else None)
    return pa.table({"row": docs.column("row"), "id": docs.column("id"), "n": docs.column("n"), "tokens": pa.array(lists, pa.list_(pa.int64()))})


def shared_shingles(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``row``, ``id``, ``n`` (distinct shingles) and ``tokens`` (those in several documents, rarest first) of every document.

    ``row`` numbers the documents apart, also those that agree in their id or have none.
    ``tokens`` is null where less than the threshold's share is shared; such a document links with nothing.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    count = exchange.ranges(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    base = f"chunk bigint, part int, row bigint, id {kind}, n bigint, a binary, b binary"
    asked = rows.mapInArrow(lambda batches: _questions(batches, count, words), f"key int, {base}")
    answered = asked.groupBy("key").applyInArrow(lambda t: _answer(t, count), f"{base}, c binary")
    return answered.groupBy("chunk").applyInArrow(lambda t: _shared(t, count, threshold), f"row bigint, id {kind}, n bigint, tokens array<bigint>")


def need(n: Column, threshold: int = THRESHOLD) -> Column:
    """Shingles that a set of size ``n`` shares with any set it links to, at least."""
    return F.ceil(n * threshold / F.lit(100)).cast("int")


def classes(shared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets (``cls``, ``n``, ``tokens``), each once, classes (``cls``, ``low``) and the membership (``row``, ``id``, ``cls``).

    Sets that equal another have all their shingles in common with it, so size and tokens tell them apart; a set with
    shingles of its own is a class of its own. The class is named by its smallest row, as one id may have several sets;
    ``low`` is its smallest id. Documents without an id belong to no class.
    """
    able = shared.where("id is not null and tokens is not null and n > 0")
    whole = F.size("tokens") == F.col("n")
    marks = [F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), F.when(whole, F.col("tokens")), F.when(~whole, F.col("row"))).alias("h2")]
    members = able.select("row", "id", "n", *marks)
    # written first, so that the join below deals both sides and may split a class of very many copies
    named = materialize(members.groupBy("n", "h1", "h2").agg(F.min("row").alias("cls"), F.min("id").alias("low")), "classes")
    membership = members.join(named, ["n", "h1", "h2"]).select("row", "id", "cls")
    one_each = able.select("row", "n", "tokens").join(named.select(F.col("cls").alias("row")), "row", "left_semi")
    return one_each.withColumnRenamed("row", "cls"), named.select("cls", "low"), membership


def same_ids(membership: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between the classes of ids that occur in several."""
    own = membership.select("id", "cls").distinct()
    several = membership.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last").select("id", "a")
    return own.join(several, "id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()


def boundary(sets: DataFrame, threshold: int = THRESHOLD) -> int:
    """Largest size of a light set: least cost of emitting entries and reading lists.

    Costs are summed by size, in steps of a sixteenth of a doubling from 64 on, so a few hundred numbers reach the
    driver.
    """
    prefix = F.col("m") - F.col("need") + 1
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.pow(2.0, F.floor(F.log2(F.col("n").cast("double")) * 16) / 16))).cast("bigint")
    emitted = sets.groupBy(step.alias("size")).agg(F.sum(prefix * (prefix + 1) / 2).alias("subsets"), F.sum(prefix).alias("singles"))
    single = sets.select(step.alias("size"), F.explode(F.slice("tokens", 1, prefix)).alias("token"))
    lengths = single.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    read = single.join(lengths, "token").groupBy("size").agg(F.sum("length").alias("read"))
    costs = emitted.join(read, "size", "left").collect()
    best, least = 0, None
    for limit in sorted({0, *(r["size"] for r in costs)}):
        cost = EMIT_COST * sum(r["subsets"] for r in costs if r["size"] <= limit)
        cost += sum(EMIT_COST * r["singles"] + READ_COST * (r["read"] or 0) for r in costs if 100 * r["size"] > threshold * limit)
        if least is None or cost < least:
            best, least = limit, cost
    return int(best)


def signatures(sets: DataFrame, limit: int, threshold: int = THRESHOLD) -> DataFrame:
    """List entries: ``key``, ``cls``, ``n``, ``rem`` and ``central``.

    Keys are subsets of two for sets up to ``limit``, and single shingles from the threshold's share of it on. ``rem``
    counts the shared shingles of the set from the key's first one on.
    """
    spare = "m - need"
    subsets = f"""flatten(transform(sequence(1, {spare} + 1), i -> transform(slice(tokens, i + 1, {spare} + 2 - i),
        y -> struct(xxhash64(tokens[i - 1], y) as key, m - i + 1 as rem))))"""
    singles = f"transform(slice(tokens, 1, {spare} + 1), (x, i) -> struct(xxhash64(x) as key, m - i as rem))"
    columns = ["entry.key", "cls", "n", "entry.rem", "central"]
    light = sets.where((F.col("n") <= limit) & (F.col("m") >= 2)).select("*", F.explode(F.expr(subsets)).alias("entry"))
    heavy = sets.where(F.col("n") * 100 > threshold * limit).select("*", F.explode(F.expr(singles)).alias("entry"))
    return light.select(*columns).unionByName(heavy.select(*columns))


def _can_link(a: Column, rem_a: Column, b: Column, rem_b: Column, threshold: int) -> Column:
    """Whether two entries of a list may belong to linked sets that have no common shingle before this key.

    The smaller size is at least the threshold's share of the larger, and enough shingles remain. A linked pair passes
    in the list of its first common shingles.
    """
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * threshold
    return sizes & (F.least(rem_a, rem_b) * (100 + threshold) >= (a + b) * threshold)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (``a``, ``b``) of classes that link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(common * (100 + threshold) >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def link_components(sets: DataFrame, given: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``node`` and ``root`` of every class that links with another, by its set or by the links ``given``."""
    limit = boundary(sets, threshold)
    emitted = signatures(sets, limit, threshold)
    head = F.max_by(F.struct("cls", "n", "rem"), F.struct("central", "cls")).alias("head")
    lists = emitted.groupBy("key").agg(head, F.count(F.lit(1)).alias("entries")).where("entries > 1").drop("entries")
    entries = materialize(emitted.drop("central").join(lists, "key"), "list-entries")
    near_head = _can_link(F.col("n"), F.col("rem"), F.col("head.n"), F.col("head.rem"), threshold) & (F.col("cls") != F.col("head.cls"))
    pair = [F.least("cls", "head.cls").alias("a"), F.greatest("cls", "head.cls").alias("b")]
    first = materialize(entries.where(near_head).select(*pair).distinct(), "pairs")
    links = materialize(verify(first, sets, threshold), "verified")
    roots = components(links)
    rooted = entries.drop("head").join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", "rem", F.coalesce("root", "cls").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = materialize(rooted.join(split.drop("roots"), "key"), "mixed-lists")
    outside = mixed.where("root <> main").select("key", *(F.col(c).alias(f"o_{c}") for c in ("cls", "n", "rem", "root")))
    able = _can_link(F.col("o_n"), F.col("o_rem"), F.col("n"), F.col("rem"), threshold)
    second = (
        outside.join(mixed, (outside["key"] == mixed["key"]) & (F.col("o_root") != F.col("root")) & able)
        .select(F.least("o_cls", "cls").alias("a"), F.greatest("o_cls", "cls").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    return components(links.unionByName(verify(second, sets, threshold)).unionByName(given))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``id_column``, ``n_shingles`` and ``component_id`` of every document.

    Words are runs of characters other than white space (ASCII), A-Z lower-cased; a shingle is ``words`` words in a
    row, or the whole sequence of a shorter text. Two documents link when ``threshold`` hundredths of the union of
    their shingles are common; the component is the smallest id reachable by links. A null, empty or blank text has
    no shingles and is its own component. A repeated id is several documents of one component; a null id stays null.
    An empty table gives an empty table; other columns are ignored.
    """
    shared = materialize(shared_shingles(docs, id_column, text_column, words, threshold), "shared")
    one_each, lowest, membership = classes(shared)
    frequency = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda total, t: total + F.shiftright(t, exchange.KEY_BITS))
    sets = one_each.withColumns({"m": F.size("tokens"), "need": need(F.col("n"), threshold), "central": frequency / F.col("n")})
    sets = materialize(sets, "sets")
    membership = materialize(membership, "membership")
    roots = link_components(sets, same_ids(membership), threshold)
    # classes that link with none keep their own smallest id; the others are written, so that a large component may be split
    linked = materialize(lowest.join(roots, F.col("cls") == F.col("node")).select("cls", "root", "low"), "rooted")
    reached = linked.groupBy("root").agg(F.min("low").alias("reached"))
    named = linked.select("cls", "root").join(reached, "root").select(F.col("cls").alias("node"), "reached")
    placed = membership.join(named, F.col("cls") == F.col("node"), "left").join(lowest.withColumnRenamed("cls", "own"), F.col("cls") == F.col("own"))
    placed = placed.select("row", F.coalesce("reached", "low").alias("component_id"))
    return (
        shared.select("row", "id", "n")
        .join(placed, "row", "left")
        .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )
