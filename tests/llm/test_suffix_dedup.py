"""Repeated passages against a plain search of all windows."""

import random

import numpy as np
import pytest
from helpers import documents, texts

from voltmill.llm import suffix_dedup


def plainly(rows, span):
    """Removed bytes of each row by a dictionary of all windows."""
    smallest = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for k in range(len(t) - span + 1 if i is not None else 0):
            w = t[k : k + span]
            smallest[w] = min(smallest.get(w, i), i)
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - span + 1 if i is not None else 0):
            if smallest[t[k : k + span]] < i:
                gone[k : k + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int)))))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in frame.collect()), key=str)


def repetitive(seed, count):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randrange(10, 160))) for _ in range(6)]
    rows = []
    for i in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((rng.choice([i, i, i, None, -i, i // 2]), "".join(parts)))
    return rows


@pytest.mark.parametrize("span", [16, 50])
def test_documents(spark, span, monkeypatch):
    for name, value in (("CHUNK_BYTES", 3000), ("RANGE_BYTES", 2000), ("BUCKET_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [*enumerate(texts()), *((None if i is None else 100 + i, t) for i, t in repetitive(span, 150)), (7, "x" * 500), (3, "x" * 700), (500, "xy" * 300), (400, "yx" * 100)]
    rows += [(None, rows[5][1]), (5, rows[5][1]), *repetitive(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffix_dedup.remove_repeats(docs, span=span)) == plainly(rows, span)
    monkeypatch.setattr(suffix_dedup, "COMMON", 3)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 5)
    assert found(suffix_dedup.remove_repeats(docs, span=span)) == plainly(rows, span)


def test_awkward_tables(spark):
    docs = documents(spark)
    assert found(suffix_dedup.remove_repeats(docs)) == plainly(list(enumerate(texts())), 50)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (2, "short"), (None, "short")], "doc_id int, text string")
    assert [r[2] for r in found(suffix_dedup.remove_repeats(none))] == [[], [], [], []]
    with pytest.raises(ValueError, match="span"):
        suffix_dedup.remove_repeats(docs, span=8)


@pytest.mark.parametrize("span", [16, 20, 50])
def test_index_finds_the_smallest_document_of_every_window(span):
    rng = random.Random(span)
    for _ in range(40):
        letters = rng.choice(["ab", "abc\0\xfe", "a"])
        strings = {"".join(rng.choice(letters) for _ in range(rng.randrange(span, span + 60))).encode("latin-1") for _ in range(rng.randrange(1, 30))}
        base = max(strings, key=len)
        strings |= {base[k:] for k in range(len(base) - span + 1)}
        strings = sorted(strings, key=lambda s: rng.random())
        documents = np.array([rng.randrange(-20, 20) for _ in strings])
        index = suffix_dedup.RunIndex(strings, documents, span)
        want = [min(d for s, d in zip(strings, documents, strict=True) if t[k : k + span] in s) for t in strings for k in range(len(t) - span + 1)]
        assert index.smallest().tolist() == want


def test_samples_stay_few_in_repetitive_text():
    rng = random.Random(1)
    base = bytes(rng.randrange(128) for _ in range(4000))
    strings = []
    for k in range(30):
        own = bytearray(base)
        own[rng.randrange(len(own))] ^= 1
        strings.append(bytes(own))
    index = suffix_dedup.RunIndex(strings, np.arange(30), 50)
    assert len(index.symbol) < index.n / 15 and len(index.sample) < index.n / 15
