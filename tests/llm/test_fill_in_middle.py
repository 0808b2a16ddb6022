"""Fill-in-middle against string slicing, and back."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import documents, texts

from voltmill.llm import fill_in_middle as fim

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_every_document_and_back(spark):
    more = ["<P>", "a<S>b", "x<M", "<", "<<P", "P>S>M>", "é<é" * 9, "\U0001f600a\U0001f600", "a\x00b", "ab" * 200_000, "\n" * 50]
    rng = random.Random(2)
    more += ["".join(rng.choice("ab <PSM>é中\n\U0001f600") for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = [*texts(), *more]
    docs = documents(spark, rows)
    found = fim.restore(fim.transform(docs)).collect()
    assert sorted(tuple(r)[:6] for r in found) == sorted((plainly(i, t) for i, t in enumerate(rows)), key=lambda r: r[0])
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert all(r.restored == (rows[r.doc_id] or "") for r in found)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "some words here"), (None, None), (3, "ties and ties"), (3, "ties and ties"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = fim.transform(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted((plainly(i, t) for i, t in rows), key=str)
    assert fim.restore(fim.transform(docs.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None, "psm"), (2, "x", None)], "doc_id int, output string, form string")
    assert [r.restored for r in fim.restore(nulls).collect()] == [None, None]


@pytest.mark.parametrize("size", [0, 1, 2, 7, fim.BLOCK, 2 * fim.BLOCK, 5 * fim.BLOCK + 3])
def test_rotation_in_place(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, size, dtype=np.uint8)
    for middle in {0, size // 3, size // 2, size}:
        turned = data.copy()
        fim.rotate(turned, 0, middle, size)
        assert (turned == np.concatenate((data[middle:], data[:middle]))).all()
        fim.rotate(turned, 0, size - middle, size)
        assert (turned == data).all()


def test_sentinels_that_overlap_are_refused(spark):
    docs = documents(spark, ["a"])
    for marks in (("<a", "a<", "x"), ("ab", "abc", "x"), ("", "b", "c"), ("xyx", "b", "c")):
        with pytest.raises(ValueError, match="overlap"):
            fim.transform(docs, sentinels=marks)
