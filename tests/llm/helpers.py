"""Awkward small tables and plain reimplementations for the operator tests."""

import random
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Columns whose names the operators also use inside.
CLASHING = "id string, start string, length string, key string, part string, n string, tokens string, score string, shard string, slot string, position string, rank string, kept string, record string, cell string, _id string, _text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def texts():
    rng = random.Random(5)
    words = ["plain", "Words", "été", "中文", "don't", "a1", "b2", "x", "The", "moron", "cc", "by", "all", "rights", "reserved"]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.replace("plain", "PLAIN").split()
    near[60] = "changed"
    return [
        None,
        "",
        "   \n\t ",
        "one",
        "two words",
        base,
        base,
        base.upper() if base.isascii() else base,
        " ".join(near),
        "a" * 9000,
        " ".join(f"w{rng.randrange(5000)}" for _ in range(30000)),
        "repeat this line\n" * 40,
        "General Public License v3 \x00 \U0001f600 ||| $$$ all rights reserved",
        "tie tie tie tie tie tie",
        *(" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(60, 90))) for _ in range(25)),
    ]


def documents(spark, rows=None):
    """Documents with null texts, languages and sources, repeats, long texts and columns of clashing names."""
    rows = texts() if rows is None else rows
    names = [c.split()[0] for c in CLASHING.split(", ")]
    data = [(i, t, [None, "en", "fr"][i % 3], [None, "s0"][i % 2], len(t or ""), *["clash"] * len(names)) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)
