"""Sharding, URL filter and the pipeline."""

import random
from collections import Counter
from urllib.parse import urlsplit

import corpus_pipeline
from helpers import documents, texts
from pyspark.sql import functions as F

from voltmill.llm import jaccard, packing, quality, queries, sharding, toxicity, urls

SMALL = "/root/testdata/sf0.001"


def test_shards_hold_all_rows_once(spark):
    docs = documents(spark)
    rows = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=20_000).collect()
    assert sorted(r.record.doc_id for r in rows) == list(range(len(texts())))
    assert all(r.record.text == texts()[r.record.doc_id] and r.record.shard == "clash" for r in rows)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_depends_on_seed_and_not_on_partitions(spark):
    docs = documents(spark)

    def order(frame, seed):
        rows = sharding.shuffle_into_shards(frame, shards=3, seed=seed, bucket_bytes=20_000).collect()
        return {r.record.doc_id: (r.shard, r.slot) for r in rows}

    assert order(docs, 1) == order(docs.coalesce(1).orderBy(F.desc("doc_id")), 1) != order(docs, 2)


def test_order_is_uniform(spark):
    """Every record is about as often in every shard."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1)
    seen = Counter()
    for seed in range(25):
        seen.update((r.record.doc_id, r.shard) for r in sharding.shuffle_into_shards(rows, shards=2, seed=seed, bucket_bytes=100).collect())
    first = [seen[i, 0] for i in range(40)]
    assert 2 <= min(first) and max(first) <= 23


def test_sharding_of_odd_tables(spark):
    assert sharding.shuffle_into_shards(documents(spark).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, None), (1, "same"), (1, "same")], "doc_id long, text string")
    found = sharding.shuffle_into_shards(rows, shards=24).collect()
    assert len(found) == 4 and {r.slot for r in found} == {0} and len({r.shard for r in found}) == 4


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://WWW.Example.ORG/en/12?x#y",
    "https://a.example.org/es/4",
    "https://example.org/EN/1",
    "https://notexample.org/es/4",
    "https://com/fr/1",
    "x://shop.example.com/de/7.html",
    "x://shop.example.com/fr",
    "x://É.example.com?/de/1",
    "x://host#frag/ment",
    "a://b://c/d",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "t", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, template string, purity double")
    for r in urls.judge(pages).collect():
        u = URLS[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if c.isascii() else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        assert (r.host, r.path) == (host, path)
        fits = [x for x in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        assert r.rule == max(fits, key=len, default=None)
        if r.rule:
            assert r.verdict == ("block" if urls.RULES[r.rule] else "allow")
    assert urls.judge(pages.limit(0)).count() == 0
    assert urlsplit(URLS[5]).hostname == "a.example.org"


def test_branches_with_other_labels_stay_apart(spark):
    """A blocked branch colours unlabelled pages below it only; numbers become wildcards."""
    rows = [f"x://news.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(200)] + [f"x://news.com/it/{i}" for i in range(40)] + [f"x://news.com/DE/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = urls.judge(pages).collect()
    assert {r.template for r in found if "/de/" in r.path} == {"/de/*"}
    assert {r.template for r in found if "/fr/" in r.path} == {"/fr/*"}
    assert {r.template for r in found if "/it/" in r.path} == {"/*/*"}
    purity = {r.template: r.purity for r in found}
    assert purity["/de/*"] > 0.8 > 0.2 > purity["/fr/*"]


def test_stages_are_what_brute_force_keeps(spark):
    """Each stage drops exactly the documents that its operator rejects, and keeps whole rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    rejected = [
        lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).collect() if r.score >= 0.5},
        lambda d: {r.doc_id for r in quality.judge(d).collect() if not r.kept},
        lambda d: {r.doc_id for r in jaccard.jaccard_components(d).collect() if r.component_id != r.doc_id},
    ]
    for (_, stage), gone in zip(corpus_pipeline.STAGES, rejected, strict=False):
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        before = {r.doc_id: r for r in docs.collect()}
        out = gone(docs)
        assert {r.doc_id: r for r in kept.collect()} == {i: r for i, r in before.items() if i not in out}
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert {(r.doc_id, r.piece) for r in packed} == {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SMALL).collect()}


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_stages_judge_rows_and_not_ids(spark, tmp_path):
    """A rejected row takes no other row of its id, or without an id, along; one row of each group of copies stays."""
    rng = random.Random(6)

    def text(name, count=80):
        return " ".join(f"{name}{rng.choice('abcdefgh')}{rng.choice('klmnop')}{k}" for k in range(count))

    good = [text(f"t{k}") for k in range(12)]
    changed = good[8].replace(good[8].split()[70], "changed")
    rows = [(None, good[0]), (None, good[1]), (None, "short"), (1, good[2]), (1, good[3]), (1, "short")]
    rows += [(2, good[4]), (2, good[4]), (3, good[4]), (None, good[5]), (None, good[5]), (4, good[5]), (None, good[6]), (None, good[6]), (5, good[8]), (5, changed), (5, good[9])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, docs, SMALL).collect()), key=str)
    assert kept == sorted([r for r in rows if r[1] != "short"], key=str)
    path = f"{tmp_path}/documents"
    docs.write.parquet(path)
    for frame in (docs, spark.read.parquet(path)):
        left = corpus_pipeline.drop_near_copies(spark, frame, SMALL)
        assert left.columns == docs.columns
        got = [(r.doc_id, r.text) for r in left.collect()]
        assert sum(t in (good[8], changed) for _, t in got) == 1
        got = [r for r in got if r[1] not in (good[8], changed)]
        want = [(None, good[0]), (None, good[1]), (1, good[2]), (1, good[3]), (2, good[4]), (4, good[5]), (None, good[6]), (5, good[9])]
        assert sorted((r for r in got if r[1] != "short"), key=str) == sorted(want, key=str)
        assert [r for r in got if r[1] == "short"] == [(1, "short")]


def test_toxic_rows_leave_others_of_their_id(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(30)] + ["grumbus"] * (i % 4 == 0))) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean, toxic = rows[1][1], rows[0][1]
    rows += [(None, clean), (None, toxic), (1000, toxic), (1000, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert [r.text for r in left if r.doc_id is None] == [clean] and [r.text for r in left if r.doc_id == 1000] == [clean]


def test_queries_cover_their_tables(spark):
    for name, query in queries.QUERIES.items():
        table = {"op4_urls": "pages", "op6_topk": "embeddings"}.get(name, "documents")
        rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
        if name == "op6_topk":
            continue
        found = query(spark, SMALL)
        key = "page_id" if table == "pages" else "doc_id"
        assert found.select(key).distinct().count() == rows.count(), name
    assert packing.CAPACITY == 2048
