"""Byte-level BPE and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import documents, texts
from tokenizers import Tokenizer

from voltmill.llm import arrays, bpe, packing, pretokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("tests", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(count):
    rng = random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "'", "s", "re", "'ll", "1", "½", "é", "中", " ", "　", "!", "...", "́", "😀", "\t", "\x1c", "Ⅷ", "'d", "zz"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(count)]


def test_pretokens_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rows = random_texts(3000) + ["don't", "'sx", " 's", "!'s", "a  b", "a \n b", "x\n", "'", " '", ""]
    data, bounds = arrays.text_bytes(pa.array(rows))
    starts = pretokens.pretoken_starts(data, bounds).tolist()
    raw = data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    assert found == [m for t in rows for m in pattern.findall(t)]


def test_merges_equal_the_library(ranks, reference):
    encoder = bpe.Encoder(ranks)
    rng = random.Random(4)
    words = ["a" * 700, "ab" * 300, "é" * 200, "Donaudampfschifffahrtsgesellschaft" * 5]
    words += ["".join(rng.choice("abcdeéßñ中 t") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for word in words:
        data = word.encode()
        assert encoder.encode(data) == reference._encode_single_piece(data), word


def test_compatibility_is_what_merging_gives(ranks):
    encoder = bpe.Encoder(ranks)
    rng = random.Random(6)
    able = [r for r, t in encoder.tokens.items() if 1 < len(t) < 8 and encoder.merge(t) == [r]]
    for _ in range(3000):
        left, right = rng.choice(able), rng.choice(able)
        assert encoder._fits(left, right) == (encoder.merge(encoder.tokens[left] + encoder.tokens[right]) == [left, right])


def test_memory_starts_over(ranks, reference):
    encoder = bpe.Encoder(ranks)
    gather = bpe.Gatherer(lambda spans: map(encoder.encode, spans), memory=5)
    for text in random_texts(30):
        data, bounds = arrays.text_bytes(pa.array([text, text]))
        counts, ids = gather(data, bounds)
        assert ids.tolist() == reference.encode_ordinary(text) * 2
        assert counts[0] == counts[1]


def thue_morse(size):
    """Two words of ``size`` letters that a polynomial modulo a power of two cannot tell apart."""
    ones = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_polynomials_confuse(ranks, reference, size):
    encoder = bpe.Encoder(ranks)
    gather = bpe.Gatherer(lambda spans: map(encoder.encode, spans))
    pair = thue_morse(size)
    data, bounds = arrays.text_bytes(pa.array(pair))
    counts, ids = gather(data, bounds)
    assert len(set(arrays.SpanHasher()(data, bounds[:-1], bounds[1:]).tolist())) == 2
    assert np.split(ids, [counts[0]])[0].tolist() == reference.encode_ordinary(pair[0])
    assert np.split(ids, [counts[0]])[1].tolist() == reference.encode_ordinary(pair[1])
    library = Tokenizer.from_file(JSON)
    gather = packing._tokenizer_gatherer(JSON)
    counts, ids = gather(data, bounds)
    assert ids.tolist() == [i for word in pair for i in library.encode(word, add_special_tokens=False).ids]


def test_colliding_hashes_change_nothing(ranks, reference):
    encoder = bpe.Encoder(ranks)
    gather = bpe.Gatherer(lambda spans: map(encoder.encode, spans))
    gather.hasher = lambda data, starts, ends: np.minimum(ends - starts, 2).astype(np.uint64)
    rows = random_texts(60)
    for _ in range(2):
        data, bounds = arrays.text_bytes(pa.array(rows))
        counts, ids = gather(data, bounds)
        assert ids.tolist() == [i for t in rows for i in reference.encode_ordinary(t)]


def test_encode_and_decode(spark, reference):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts())))
    for r in rows:
        text = texts()[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS), RANKS).count() == 0


def test_decoding_refuses_unknown_ids_and_skips_nulls(spark):
    lists = spark.createDataFrame([(1, [64, None, 65]), (2, None), (3, [])], "doc_id int, ids array<int>")
    found = {r.doc_id: bytes(r.decoded) for r in bpe.decode(lists, RANKS).collect()}
    assert len(found[1]) == 2 and found[2] == b"" and found[3] == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id int, ids array<int>"), RANKS).collect()


def check_plan(counts, capacity):
    held, numbers = {}, {}
    for length, first, count, sequence, offset in packing.plan(counts, capacity):
        assert numbers.get(length, 0) == first
        numbers[length] = first + count
        for i in range(count):
            held.setdefault(sequence + i, []).append((offset, length))
    assert numbers == counts
    assert sorted(held) == list(range(len(held)))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in places) <= 2
    return len(held)


def test_plans_are_whole_and_gapless():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100, 2048])
        check_plan({rng.randint(1, capacity): rng.choice([1, 2, 3, 5, 200]) for _ in range(rng.randint(0, 50))}, capacity)
    assert packing.plan({}, 10) == []


def test_plan_is_near_the_least_number():
    rng = random.Random(8)
    counts = {n: rng.randint(1, 40) for n in range(1, 2049)}
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert check_plan(counts, 2048) <= 1.005 * least + 1


def test_pieces_and_places(spark):
    tokenizer = Tokenizer.from_file(JSON)
    docs = documents(spark)
    capacity = 256
    pieces = packing.pack(docs, JSON, capacity).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts())))
    for doc, rows in by_doc.items():
        ids = [*tokenizer.encode(texts()[doc] or "", add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(rows):
            assert (r.piece, r.start) == (k, at)
            assert len(ids) <= capacity or k == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(rows) == 1) == (len(ids) <= capacity)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert packing.pack(docs.limit(0), JSON, capacity).count() == 0


def test_literals_of_added_tokens_are_their_ids(spark):
    token = "<|endoftext|>"
    rows = [f"hi {token} there", token, f"{token}start", f"end{token}", f"  {token}  \n", f"{token}{token} {token}", f"a<|endof{token}text|>", "<|endoftext|", "|>", "", None, "plain", f"é{token}中 文"]
    tokenizer = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in packing.cut(docs, JSON, 256).collect()}
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(rows)}
    assert got[0] == [5303, 220, 50256, 612, 0]


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "same text")] * 7 + [(None, "no id")], "doc_id long, text string")
    rows = packing.pack(docs, JSON, 8).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 8


def test_lengths_outside_the_range_are_refused(spark):
    with pytest.raises(ValueError, match="between 1 and"):
        packing.place(spark.createDataFrame([(1, 9)], "doc_id int, length int"), ["doc_id"], 8)


def test_digest_query(spark, reference):
    from voltmill.llm import queries

    small = "/root/testdata/sf0.001"
    rows = queries.op3_bpe(spark, small).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        ids = reference.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
