"""Toxicity, quality rules, license scans and the language model."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import PLAIN_WORDS, SPACE_WORDS, documents, lower, texts
from pyspark.sql import functions as F

from voltmill.llm import arrays, exchange, language_model, licenses, quality, queries, toxicity

SMALL = "/root/testdata/sf0.001"


# toxicity


def test_passes_equal_enumeration():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.zeros(1), 0.0, rng.normal(size=(2, 2)), -0.3, np.zeros(4))
    odds = np.exp(rng.normal(size=41))
    edges = [0, 1, 5, 6, 16, 30, 41]
    opens = np.zeros(41, bool)
    opens[edges[:-1]] = True
    forward, backward = toxicity.passes(odds, opens, model)
    p = forward * backward / (1 + forward * backward)
    for begin, end in itertools.pairwise(edges):
        paths = list(itertools.product([0, 1], repeat=end - begin))
        weight = []
        for path in paths:
            w = math.exp(model.first * path[0])
            for i, state in enumerate(path):
                w *= odds[begin + i] ** state * (math.exp(model.transition[path[i - 1], state]) if i else 1)
            weight.append(w)
        for i in range(end - begin):
            want = sum(w for w, path in zip(weight, paths, strict=True) if path[i]) / sum(weight)
            assert abs(want - p[begin + i]) < 1e-9


def labelled(spark, count=600):
    """Documents of common words; half of the labelled ones hold a slur of two stems."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(count):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["grumbus", "Snarko"]) + rng.choice(["", "en", "isch", "ata"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_spans(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).withColumn("held_out", toxicity.held_out()).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) / len(held) >= 0.97
    for r in held:
        for s in r.spans:
            assert re.match("grumb|snark", r.text[s.start : s.end].lower())


def test_scores_do_not_use_labels_of_held_out_documents(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert first == second


def test_awkward_documents_are_scored(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1), (20, 0), (21, 0), (None, 1), (22, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts())))
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    unlabelled = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_long_texts_leave_the_sample_whole(spark, monkeypatch):
    """A text over the bounds is passed over; others of its class and both classes stay."""
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1000)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5000)
    drawn = spark.range(400).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64(F.col("id").cast("string")))
    ids = [r.doc_id for r in drawn.collect()]
    flags = {i: int(k % 2) for k, i in enumerate(ids)}
    labels = spark.createDataFrame(list(flags.items()), "doc_id long, toxic int")

    def sampled(size):
        docs = spark.createDataFrame([(i, f"text {i} " + "x" * size(k)) for k, i in enumerate(ids)], "doc_id long, text string")
        return [r for r in toxicity.sample(docs, labels, F.lit(True), "doc_id", "text", "toxic").collect()]

    rows = sampled(lambda k: 9000 if k < 10 else 190)  # the first of each class are too long
    for label in (0, 1):
        assert 20 <= sum(r.label == label for r in rows) <= 25
    assert max(len(r.text) for r in rows) < 300
    for size in (lambda k: 9000 + k, lambda k: 9000 + k if k % 2 else 100):  # all of both classes, all of one
        rows = sampled(size)
        assert {r.label for r in rows} == {0, 1}
        assert [r.text.split()[1] for r in rows if r.label] == [str(ids[1])]


def test_one_long_text_does_not_use_up_the_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TOKENS", 4000)
    rng = random.Random(3)
    texts = ["word " * 10_000]
    texts += [" ".join([f"w{rng.randrange(100)}" for _ in range(20)] + ["grumbus"] * (i % 2)) for i in range(150)]
    flags = [0, *(i % 2 for i in range(150))]
    sizes = np.array([len(t.split()) for t in texts])
    taken = toxicity._fill(np.arange(len(texts)), sizes, np.array(flags, bool))
    assert len(taken) == 150 and sizes[taken].sum() <= 4000
    model = toxicity.fit(texts, flags)
    hasher = arrays.SpanHasher(arrays.lower_table())
    import pyarrow as pa

    keys, _, _, first = toxicity.features(*arrays.text_bytes(pa.array(["w1 w2 grumbus w3", "w1 w2 w3"], pa.large_string())), hasher)
    p = toxicity.marginals(keys, first, model)
    assert p[2] > 0.9 and p[[0, 1, 3, 4, 5, 6]].max() < 0.1
    lone = toxicity._fill(np.arange(2), np.array([9000, 9000]), np.array([True, False]))
    assert len(lone) == 2


# quality


def plain_statistics(text):
    text = text or ""
    words = SPACE_WORDS.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["awkward", "given"])
def test_statistics(spark, table):
    docs = documents(spark) if table == "awkward" else spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = quality.judge(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        want = plain_statistics(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0)).count() == 0


def test_outliers_are_rejected_and_the_rest_kept(spark):
    """A tenth of junk does not pull the estimate; every group judges by itself."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(100)]
        if i % 10 == 0:
            words = [w + rng.choice(["$$$", "%%%", "###"]) for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 2}"))
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in judged)


def test_quality_runs_no_python(spark):
    plan = quality.judge(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# licenses


def test_phrases_equal_brute_force(spark):
    docs = documents(spark)
    for r in licenses.scan(docs).collect():
        words = PLAIN_WORDS.findall(lower(texts()[r.doc_id] or ""))
        want = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert r.n_words == len(words)
        assert [(p.word, p.label) for p in r.places] == want
        assert 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rules_hold_their_keyword_and_are_many():
    rules = licenses.rules()
    assert len(rules) > 300
    assert len({(r.label, r.pattern) for r in rules}) == len(rules)


def kept(text):
    scanner = licenses.Scanner()
    return [(scanner.rules[r].label, text.lower()[s:e]) for s, e, r in scanner.matches(text.lower())]


def test_priority_and_containment():
    assert kept("SPDX-License-Identifier: GPL-2.0-only") == [("gpl-2.0", "spdx-license-identifier: gpl-2.0-only")]
    labels = [label for label, _ in kept("Licensed under the Apache License, Version 2.0")]
    assert "apache-2.0" in labels
    assert [x for x, _ in kept("This work is CC BY-NC-SA 4.0.")] == ["cc-by-nc-sa-4.0"]
    assert kept("nothing mit to see") == []


def test_prefilter_loses_nothing():
    """Running every rule without keywords gives the same matches."""
    scanner = licenses.Scanner()
    samples = ["licensed under the mit license", "gnu general public license v3", "creative commons attribution 4.0 (c) 2020 me", "mozilla public license 2.0, bsd 3-clause license"]
    for text in samples:
        every = [(m.start(), m.end(), i) for i, rule in enumerate(scanner.rules) for m in re.finditer(rule.pattern, text)]
        every.sort(key=lambda m: (-scanner.rules[m[2]].priority, m[0] - m[1], m[0], m[2]))
        assert sorted(licenses._outermost(every)) == scanner.matches(text)


def written(rng, parsed):
    """A random text that a parsed pattern matches, but for what look-arounds refuse."""
    out = []
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out.append(chr(value))
        elif kind == "IN":
            pick = rng.choice(value)
            out.append({"LITERAL": lambda: chr(pick[1]), "CATEGORY": lambda: rng.choice(["7", " ", "\n", "  "][:1] if "DIGIT" in str(pick[1]) else [" ", "\n", "\t"]), "NEGATE": lambda: "x", "RANGE": lambda: chr(pick[1][0])}[str(pick[0])]())
        elif kind == "NOT_LITERAL":
            out.append("x")
        elif kind == "BRANCH":
            out.append(written(rng, rng.choice(value[1])))
        elif kind == "SUBPATTERN":
            out.append(written(rng, value[3]))
        elif kind == "MAX_REPEAT":
            low, high, inner = value
            out += [written(rng, inner) for _ in range(rng.randint(low, min(high, low + 2)))]
        else:
            assert kind in ("AT", "ASSERT_NOT"), kind
    return "".join(out)


def test_sentences_of_every_rule_pass_the_prefilter():
    """Sentences made from each rule, with any white space, give what all rules give without literals."""
    from re import _parser

    rng = random.Random(12)
    scanner = licenses.Scanner()
    patterns = [re.compile(rule.pattern) for rule in scanner.rules]
    matched = 0
    for rule in scanner.rules:
        for _ in range(3):
            text = f"so, {written(rng, _parser.parse(rule.pattern))} ."
            every = [(m.start(), m.end(), i) for i, pattern in enumerate(patterns) for m in pattern.finditer(text)]
            every.sort(key=lambda m: (-scanner.rules[m[2]].priority, m[0] - m[1], m[0], m[2]))
            assert sorted(licenses._outermost(every)) == scanner.matches(text), text
            matched += re.search(rule.pattern, text) is not None
    assert matched > 2.8 * len(patterns)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Released under the ISC.", "isc"),
        ("distributed under the PHP, version 3", "php"),
        ("licensed under the Artistic 2.0 terms", "artistic"),
        ("available under OpenSSL terms", "openssl"),
        ("licensed under the Elastic 2.0", "elastic"),
        ("the ISC public license", "isc"),
        ("GNU  General\n Public\tLicense", "gpl"),
        ("licensed  under\nthe Mozilla  Public License", "mpl"),
    ],
)
def test_forms_of_names_are_found(text, label):
    assert label in [x for x, _ in kept(text)]


def test_suppression_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        ranked = [(s, s + rng.randrange(1, 12), k) for k, s in enumerate(rng.choices(range(30), k=12))]
        want = []
        for m in ranked:
            if not any(k[0] <= m[0] and m[1] <= k[1] for k in want):
                want.append(m)
        assert sorted(licenses._outermost(ranked)) == sorted(want)


# language model


def test_elias_fano():
    rng = np.random.default_rng(1)
    for count in (0, 1, 7, 500):
        values = np.sort(rng.choice(100_000, count, replace=False)).astype(np.uint64)
        sequence = language_model.EliasFano(language_model.EliasFano.encode(values, 100_001), 0)
        assert sequence.get(np.arange(count)).tolist() == values.tolist()
        wanted = rng.integers(0, 100_000, 300).astype(np.uint64)
        assert sequence.successor(wanted).tolist() == np.searchsorted(values, wanted).tolist()


def test_trie_holds_its_keys():
    rng = np.random.default_rng(2)
    base, bound = 1 << 44, 1 << 45
    keys = np.unique(rng.integers(base, bound, 4000)).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, (keys[:50, None] & ~np.uint64(0xFFFFFF) | np.arange(20, dtype=np.uint64)).ravel()]))
    keys = keys[keys >= base]
    counts = rng.integers(1, 10**6, len(keys)).astype(np.uint64)
    trie = language_model.Trie(language_model.build_trie(keys, counts, base, bound), base)
    assert (trie.codes(keys).astype(int) - 1 == language_model.quantise(counts)).all()
    others = np.setdiff1d(rng.integers(base, bound, 4000).astype(np.uint64), keys)
    others = np.concatenate([others, np.setdiff1d(keys + np.uint64(1), keys)[:-1]])
    assert not trie.codes(others).any()


def test_many_contexts_of_one_word_stay_apart():
    """A hundred thousand contexts before the same word: every bigram has a cell and a count of its own."""
    import pyarrow as pa

    contexts = 100_000
    text = " ".join(f"c{k} the" for k in range(contexts))
    own = language_model._Chunk(*arrays.text_bytes(pa.array([text, "c1 the", ""])), arrays.SpanHasher())
    tokens = [[*t.split(), None] for t in (text, "c1 the", "")]
    want = Counter(p for t in tokens for p in zip([None, *t], t, strict=False))
    assert sorted(Counter(own.pair_of.tolist()).values()) == sorted(want.values())
    model, place = {}, 0
    for t in tokens:
        for p in zip([None, *t], t, strict=False):
            assert model.setdefault(p, own.pair_of[place]) == own.pair_of[place]
            place += 1


def test_trie_tells_apart_keys_that_agree_in_one_half():
    """Contexts or words that agree in their upper or lower 24 bits."""
    base, bound = 1 << 46, 1 << 47
    contexts = np.array([base + x for x in (0, 1, 1 << 24, (1 << 24) + 1, 5 << 40, (5 << 40) + 1)], np.uint64)
    words = np.array([0, 1, 1 << 16, (1 << 16) + 1, (1 << 40) - 1], np.uint64)
    model = {(c, w): 3 ** (i + 1) for i, (c, w) in enumerate(itertools.product(contexts.tolist(), words.tolist())) if i % 3}
    keys, held = (np.array(x, np.uint64) for x in zip(*model, strict=True))
    counts = np.array(list(model.values()), np.uint64)
    trie = language_model.Trie(language_model.build_trie(keys, counts, base, bound, held), base)
    asked = list(itertools.product(contexts.tolist(), words.tolist()))
    codes = trie.codes(*(np.array(x, np.uint64) for x in zip(*asked, strict=True)))
    quantised = dict(zip(model, language_model.quantise(counts).tolist(), strict=True))
    assert codes.tolist() == [quantised[p] + 1 if p in quantised else 0 for p in asked]


def test_packing_of_keys():
    rng = np.random.default_rng(3)
    for width in (0, 1, 200, 70_000, 1 << 47):
        values = rng.integers(0, width + 1, 100).astype(np.uint64)
        assert (exchange.unpack(exchange.pack(values)) == values).all()
        assert (exchange.unpack_sorted(exchange.pack_sorted(np.sort(values) + np.uint64(5), 5), 5) == np.sort(values) + np.uint64(5)).all()
    assert len(exchange.unpack(exchange.pack(np.zeros(0, np.uint64)))) == 0


def test_scores_equal_a_plain_model(spark):
    docs = documents(spark)
    out = F.col("doc_id") % 4 == 1
    rows = {r.doc_id: r for r in language_model.score(docs, out).collect()}
    tokens = {i: [*SPACE_WORDS.findall(lower(t or "")), None] for i, t in enumerate(texts())}
    train = [t for i, t in tokens.items() if i % 4 != 1]
    single = Counter(w for t in train for w in t)
    double = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    total, known = sum(single.values()), len(single)
    assert sorted(rows) == sorted(tokens)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 1, len(t), sum(single[w] > 0 for w in t), total)
        plain = [(single[w] + 1) / (total + known + 1) for w in t]
        assert abs(r.base_score - sum(map(math.log10, plain))) < 1e-6
        mu = language_model.MU
        smooth = sum(math.log10((double[h, w] + mu * p) / (single[h] + mu)) for h, w, p in zip([None, *t], t, plain, strict=False))
        assert abs(r.score - smooth) <= 0.02 * len(t) + 1e-9
    assert language_model.score(docs.limit(0), out).count() == 0
    untrained = language_model.score(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}


def test_words_are_hashed_by_their_lower_case_bytes():
    import pyarrow as pa

    hasher = arrays.SpanHasher(arrays.lower_table())
    data, bounds = arrays.text_bytes(pa.array(["The é THE", None, "the\tÉ", ""]))
    starts, ends, first = arrays.word_spans(data, bounds, arrays.NON_SPACE)
    found = hasher(data, starts, ends)
    assert first.tolist() == [0, 3, 3, 5, 5]
    assert found[0] == found[2] == found[3] and found[1] != found[4]


def test_language_model_query_counts_everything(spark):
    rows = queries.op9_language_model(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
