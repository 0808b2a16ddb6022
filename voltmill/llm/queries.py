"""Registered queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.llm import bpe, fill_in_middle, jaccard, language_model, licenses, packing, periodic_runs, quality, sharding, suffix_dedup, topk, toxicity, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a field fitted to the labelled ones that are not held out."""
    found = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 24 shards of a seeded random order, from the written shards."""
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.shuffle_into_shards(documents(spark, sf_dir)).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir), ranks)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by the purity of its path template."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    found = licenses.scan(documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("matches", lambda m: m["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        "score",
    )


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether it is kept."""
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a model of six sevenths of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return language_model.score(documents(spark, sf_dir), held_out)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word shingles agree to four fifths."""
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that an earlier document has, as digests."""
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda done, s: done + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and restored from it, as digests."""
    restored = fill_in_middle.restore(fill_in_middle.transform(documents(spark, sf_dir)))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which the words of every tenth document repeat from some place on.

    Place, period and choice follow from the checksum of the id; a null id counts as empty. The words of such a text are
    joined by single blanks, others are left as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    turn = F.floor(drawn / 10)
    words = F.split(F.btrim(text, F.lit(quality.SPACE)), "[ \\t-\\r]+", -1)

    def repeated(ws: Column) -> Column:
        start = F.pmod(turn, F.size(ws)).cast("int")
        period = (1 + F.floor((F.size(ws) - start) / (3 + turn % 8))).cast("int")
        unit = F.slice(ws, start + 1, period)
        tail = quality.let(unit, lambda u: F.transform(F.sequence(F.lit(0), F.size(ws) - start - 1), lambda i: F.get(u, i % period)))
        return F.array_join(F.concat(F.slice(ws, F.lit(1), start), tail), " ")

    planted = (drawn % 10 == 0) & (F.btrim(text, F.lit(quality.SPACE)) != "")
    return docs.select("doc_id", F.when(planted, quality.let(words, repeated)).otherwise(text).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, the one of the most periods, and digests of all of them and of the text without them."""
    found = periodic_runs.find_runs(_with_repeats(documents(spark, sf_dir)))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs are in order, so only one of more periods replaces the best so far
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    chosen = found.withColumn("best", best)
    return chosen.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_urls": op4_urls,
    "op5_licenses": op5_licenses,
    "op6_topk": op6_topk,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_language_model": op9_language_model,
    "op10_jaccard": op10_jaccard,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Check SQL of the queries that SQL can express; tests hold the others against plain reimplementations.
SQL: dict[str, str] = {
    "op6_topk": """WITH able AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM able q JOIN able c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_jaccard": f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS x FROM sets),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.node WHERE r.root < l.b
)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(root) FROM reach r WHERE r.node = s.doc_id) AS component_id FROM sets s""",
    "op11_suffix_dedup": """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, doc_id, x, unnest(range(len(x) // 1000 + 1)) AS j FROM docs WHERE len(x) >= 100 AND doc_id IS NOT NULL),
parts AS (SELECT r, doc_id, j, substr(x, 1000 * j + 1, 1098) AS y FROM blocks),
starts AS (SELECT r, doc_id, j, y, unnest(range(len(y) // 2 - 49)) AS k FROM parts WHERE len(y) >= 100),
windows AS (SELECT r, 500 * j + k AS i, doc_id > min(doc_id) OVER (PARTITION BY substr(y, 2 * k + 1, 100)) AS again FROM starts),
repeats AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM windows WHERE again),
numbered AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM repeats),
spans AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT r, count(*) AS n, sum(g.b - g.a) AS gone, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(d.x), 2 * max(b) + 1) AS x
  FROM gaps g JOIN docs d USING (r) GROUP BY r
)
SELECT doc_id, len(docs.x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(cut.x, docs.x))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)""",
    "op12_fill_in_middle": """WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts""",
}
