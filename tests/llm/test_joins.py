"""Jaccard components, connected components and top-k search against brute force."""

import random

import numpy as np
import pytest
from helpers import SPACE_WORDS, documents, lower, texts
from pyspark.sql import functions as F

from voltmill.llm import jaccard, topk
from voltmill.llm.components import components


def shingle_set(text):
    words = SPACE_WORDS.findall(lower(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    """Set size and smallest linked id of every (id, text)."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_awkward_documents(spark):
    docs = documents(spark)
    assert found(jaccard.jaccard_components(docs)) == brute(list(enumerate(texts())))
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def near_copies(rng, groups):
    """Copies around the threshold, hubs with spokes that link only to the hub, chains, and a passage that all share."""
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(4, 150))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randrange(1, 12)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            cut = rng.randrange(0, 1 + len(words) // 10)
            rows.append(" ".join(words[cut:]))
            if rng.random() < 0.3:
                rows.append(" ".join(words[cut:]).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_copies(random.Random(seed), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.jaccard_components(docs)) == brute(rows)


@pytest.mark.parametrize("limit", [0, 40, 10**9])
def test_every_boundary_gives_the_same(spark, monkeypatch, limit):
    rows = near_copies(random.Random(3), 40)
    monkeypatch.setattr(jaccard, "boundary", lambda sets, threshold: limit)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.jaccard_components(docs)) == brute(rows)


def test_unshared_shingles_keep_sets_apart(spark):
    """Two sets with the same shared shingles but too many of their own are no copies."""
    shared = [f"s{k}" for k in range(38)]
    rows = [(i, " ".join([*shared, *(f"own{i}x{k}" for k in range(8))])) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.jaccard_components(docs)) == brute(rows)


def test_repeated_ids_join_their_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, None)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert rows == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_one_id_with_two_texts_keeps_both_sets(spark):
    """Both texts of an id name a class, and copies near either of them are found; ids join components for all."""
    rng = random.Random(4)
    a, b, c = ([f"{x}{k}" for k in range(40)] for x in "abc")

    def near(words):
        words = list(words)
        words[rng.randrange(1, 3)] = "changed"
        return " ".join(words)

    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (0, near(c)), (5, " ".join(c)), (5, near(a))]
    rows += [(None, near(a)), (None, " ".join(a)), (7, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 0), (3, 0), (0, 0), (5, 0), (5, 0), (None, None), (None, None), (7, 7), (None, None)], key=str)


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in rows} == {x: find(x) for x in linked}
    assert len(rows) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def best(vectors, asked, k):
    rows = set()
    for q, v in asked.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in vectors.items() if i != q and len(w) == len(v)))[:k]
        rows |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return rows


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = random.Random(11)
    rows = [(i, [rng.choice([-0.02, 0.0, 0.01, rng.uniform(-1, 1)]) for _ in range(6)], "clash") for i in range(240)]
    rows += [(240, None, "x"), (241, [], "x"), (242, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (243, [float("nan")] * 6, "x"), (244, [float("inf")] * 6, "x")]
    rows += [(250, [0.5, 0.5], "short"), (251, [0.25, 0.5], "short"), (None, [0.1] * 6, "no id")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(5)
    able = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and i not in range(240, 245)}
    asked = {i: v for i, v in able.items() if i % 50 == 0}
    result = topk.top_k(frame, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
    assert {tuple(r) for r in result.collect()} == best(able, asked, 5)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_top_k_block_reads_bands():
    rng = np.random.default_rng(0)
    for trial in range(30):
        wide = 6 if trial % 2 else 128
        count = int(rng.integers(1, 400))
        vectors = rng.integers(-wide, wide, (count, 8))
        ids = rng.permutation(count) * 7
        queries, query_ids = vectors[: count // 10 + 1], ids[: count // 10 + 1]
        at, row, score = topk.search_block(vectors, ids, np.ones(count, np.int64), queries, query_ids)
        for q in range(len(queries)):
            scores = vectors @ queries[q]
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query_ids[q]][:5]
            assert row[at == q].tolist() == order and score[at == q].tolist() == scores[order].tolist()


def test_top_k_of_huge_components(spark):
    """Whole numbers far beyond 53 bits: exact up to 64 bits, and the nearest bound beyond."""
    rng = random.Random(4)
    sizes = [1.0, 1e3, 1e6, 3e6, 1e18, -1e18, 1e300]
    rows = [(i, [rng.choice(sizes) * rng.uniform(0.1, 1) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low, high = -(2**63), 2**63 - 1
    whole = {i: [min(max(int(np.floor(256 * x)) if abs(x) < 1e290 else high if x > 0 else low, low), high) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50, 100):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), low), high), i) for i, v in whole.items() if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()} == want


def test_top_k_of_repeated_ids(spark, monkeypatch):
    """Rows with one id ask and answer each for itself, equal rows too."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    rows = [(rng.choice([0, 50, 50, 100, *range(1, 8)]), [float(rng.randrange(-3, 4)) for _ in range(3)]) for _ in range(60)]
    rows += [rows[0], rows[0], (50, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (50, [-1.0, 0.0, 1.0])]
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-int(sum(256 * x * 256 * y for x, y in zip(v, w, strict=True))), i) for b, (i, w) in enumerate(rows) if b != a)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
