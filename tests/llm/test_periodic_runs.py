"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import SPACE_WORDS, documents, texts

from voltmill.llm import arrays, periodic_runs, queries


def all_runs(words, length=6, periods=4):
    """Every maximal stretch of each period, without those whose smallest period is less."""
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            if size >= max(length, periods * q) and not any(p < q and words[start : start + size - p] == words[start + p : start + size] for p in range(1, q)):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.randrange(1, 5)
        words = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(6) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (block * 9)[: rng.randrange(1, 9 * len(block) + 1)]
        yield words


def test_runs_are_all_runs():
    for words in sequences(1500, 1):
        assert periodic_runs.runs_of(words) == all_runs(words), words
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 300:
        fibonacci, before = fibonacci + before, fibonacci
    for words in (fibonacci, [0] * 500, [0, 1] * 250, ([0] * 30 + [1]) * 12, [bin(i).count("1") % 2 for i in range(600)]):
        assert periodic_runs.runs_of(words) == all_runs(words)
        assert periodic_runs.runs_of(words, 6, 3) == all_runs(words, 6, 3)


def test_colours_are_last_ends():
    """After each word, every suffix was last seen where a plain search finds it."""
    rng = random.Random(3)
    for _ in range(40):
        paths, words = periodic_runs.SuffixPaths(), []
        for end in range(40):
            words.append(rng.randrange(2))
            want = set()
            for size in range(1, end + 1):
                ends = [e for e in range(size - 1, end) if words[e - size + 1 : e + 1] == words[end - size + 1 :]]
                if ends and end - ends[-1] <= size:
                    longer = [e for e in range(size, end) if words[e - size : e + 1] == words[end - size :]]
                    if not longer or longer[-1] != ends[-1]:
                        want.add((end - ends[-1], size))
            assert set(paths.append(words[-1])) == want


def test_zones_hold_every_run():
    hasher = arrays.SpanHasher()
    rng = random.Random(4)
    for words in sequences(800, 2):
        text = " ".join(f"w{w}" for w in words) + " " + " ".join(f"x{rng.randrange(9999)}" for _ in range(30))
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, first = arrays.word_spans(data, np.array([0, len(data)]), arrays.NON_SPACE)
        found = periodic_runs.zones(hasher(data, starts, ends), first)
        for start, size, _ in all_runs(text.split()):
            assert any(low <= start and start + size <= high for _, low, high in found)
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(20000)).encode()
    data = np.frombuffer(prose, np.uint8)
    starts, ends, first = arrays.word_spans(data, np.array([0, len(data)]), arrays.NON_SPACE)
    assert periodic_runs.zones(hasher(data, starts, ends), first) == []


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark):
    rng = random.Random(8)
    rows = [*texts(), "a b " * 20 + "\n tail", "x\t\x0by  " * 12, "é 中 " * 9, "one " * 5, "one " * 6]
    rows += [" \n".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(200))) for _ in range(60)]
    found = periodic_runs.find_runs(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    for r in found:
        words = SPACE_WORDS.findall(rows[r.doc_id] or "")
        runs = all_runs(words) if len(words) < 1000 else []
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        assert r.collapsed == collapse(words, runs)
    assert periodic_runs.find_runs(documents(spark, rows).limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a " * 9), (None, "a " * 9), (7, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", len(r.runs), r.collapsed) for r in periodic_runs.find_runs(twice).collect()) == [("", 1, "a"), ("", 1, "a"), ("7", 0, "")]
    with pytest.raises(ValueError, match="periods"):
        periodic_runs.find_runs(documents(spark, rows), periods=2)


def test_query_is_what_brute_force_finds(spark, tmp_path):
    rows = [(None, "tie " * 30), (10**6, None), (10**6, "")]
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        own = SPACE_WORDS.findall(text or "")
        n, h = len(own), zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            own = own[:a] + [own[a + (k - a) % p] for k in range(a, n)]
        runs = all_runs(own)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapse(own, runs))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests))
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10
