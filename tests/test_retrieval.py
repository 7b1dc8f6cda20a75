"""Ranking, isolation, deletion and fusion on small literal inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contentprint.errors import ForbiddenError, RecordNotFoundError
from contentprint.functions import text, vectors
from contentprint.operators import bm25, fusion, knn, records

TEXT = "tenant_id long, record_id long, text string"
VECTOR = "tenant_id long, record_id long, embedding array<float>"


def texts(spark, *rows):
    return spark.createDataFrame(rows, TEXT)


def ask(spark, tenant, terms, k=10):
    return spark.createDataFrame([(0, tenant, terms, k)], "qid long, tenant_id long, terms array<string>, k int")


def ids(df):
    return [r.record_id for r in df.orderBy("rank").collect()]


def vector(spark, tenant, v, k=10):
    return spark.createDataFrame([(0, tenant, v, k)], "qid long, tenant_id long, vector array<double>, k int")


def test_tokens(spark):
    row = spark.createDataFrame([("Hello, World!  It's GREAT.",), (None,), ("   ,,, ...   ",)], "t string").select(text.tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in row] == [["hello", "world", "it", "s", "great"], [], []]


def test_shingles(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(text.shingles(F.col("w"), 2)).collect()] == [["a b", "b c"], ["a"], []]


def test_bm25_ranks_by_frequency_and_terms(spark):
    df = texts(spark, (1, 100, "rust rust rust async"), (1, 101, "rust async language"), (1, 102, "go language"))
    assert ids(bm25.search(df, ask(spark, 1, ["rust"]))) == [100, 101]
    df = texts(spark, (1, 1, "rust async language"), (1, 2, "go async language"), (1, 3, "rust safety"))
    assert ids(bm25.search(df, ask(spark, 1, ["rust", "async"])))[0] == 1


def test_bm25_isolates_tenants_and_counts_empty_texts(spark):
    df = texts(spark, (1, 100, "tenant one document"), (2, 200, "tenant two document"), (1, 101, "   ,,, ...   "), (1, 102, None))
    assert ids(bm25.search(df, ask(spark, 1, ["document"]))) == [100]
    stats = {r.tenant_id: (r.n_docs, r.total_len) for r in bm25.corpus_stats(df).collect()}
    assert stats == {1: (2, 3), 2: (1, 3)}
    assert ids(bm25.search(df, ask(spark, 1, ["nothing"]))) == [] == ids(bm25.search(df, ask(spark, 1, ["document"], 0)))


def test_bm25_score(spark):
    df = texts(spark, (1, 1, "a a b"), (1, 2, "b c"))
    row = bm25.search(df, ask(spark, 1, ["a", "A"]), explain=True).collect()[0]
    idf = math.log((2 - 1 + 0.5) / 1.5 + 1)
    want = 2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert row.score == pytest.approx(want) and row.terms[0].term == "a" and row.terms[0].contribution == pytest.approx(want)


def test_delete_and_upsert_change_the_ranking(spark):
    df = texts(spark, (1, 100, "rust async"), (1, 101, "rust safety"))
    assert ids(bm25.search(records.delete(df, df.filter("record_id = 100")), ask(spark, 1, ["rust"]))) == [101]
    df = texts(spark, (1, 100, "rust " * 6), (1, 101, "rust " * 5))
    new = records.upsert(df, texts(spark, (1, 100, "rust other words here")))
    assert ids(bm25.search(new, ask(spark, 1, ["rust"])))[0] == 101


def test_bm25_ignores_the_order_of_documents(spark):
    rows = [(1, i, " ".join(random.Random(i).choices("abcdef", k=9))) for i in range(30)]
    a = bm25.search(texts(spark, *rows), ask(spark, 1, ["a", "b"])).collect()
    b = bm25.search(texts(spark, *reversed(rows)).repartition(7), ask(spark, 1, ["a", "b"])).collect()
    assert sorted((r.record_id, round(r.score, 9)) for r in a) == sorted((r.record_id, round(r.score, 9)) for r in b)


def test_knn(spark):
    df = spark.createDataFrame([(1, 100, [1.0, 0.0, 0.0]), (1, 200, [0.0, 1.0, 0.0]), (1, 300, [0.7, 0.7, 0.0]), (1, 9, None), (1, 10, [1.0, 0.0]), (1, 11, [0.0, 0.0, 0.0]), (1, 12, [float("nan"), 1.0, 1.0]), (2, 1, [1.0, 0.0, 0.0])], VECTOR)
    found = knn.search(df, vector(spark, 1, [0.6, 0.6, 0.0], 2)).orderBy("rank").collect()
    assert [r.record_id for r in found] == [300, 100] and found[0].score >= found[1].score
    assert ids(knn.search(df, vector(spark, 2, [1.0, 0.0, 0.0]))) == [1]
    assert ids(knn.search(df, vector(spark, 1, [1.0, 0.0]))) == [10]
    for q in ([0.0, 0.0, 0.0], [], None):
        assert ids(knn.search(df, vector(spark, 1, q))) == []
    assert ids(knn.search(df, vector(spark, 1, [0.0, 0.9, 0.0], 1), "l2")) == [200]


def test_rrf(spark):
    ranking = lambda *rows: spark.createDataFrame([(0, 1, i, r) for r, i in enumerate(rows, 1)], "qid long, tenant_id long, record_id long, rank int")
    got = {r.record_id: r for r in fusion.rrf({"vector": ranking(10, 20), "bm25": ranking(20, 30)}).collect()}
    assert (got[20].vector_rank, got[20].bm25_rank) == (2, 1) and got[20].score == pytest.approx(1 / 62 + 1 / 61)
    assert got[10].bm25_score is None and got[30].vector_score is None
    swapped = {r.record_id: r.score for r in fusion.rrf({"bm25": ranking(20, 30), "vector": ranking(10, 20)}).collect()}
    assert swapped == {k: r.score for k, r in got.items()}


def test_dispatch_on_the_shape_of_queries(spark):
    df = spark.createDataFrame([(1, 1, "rust", [1.0, 0.0]), (1, 2, "go", [0.0, 1.0])], TEXT + ", embedding array<float>")
    both = spark.createDataFrame([(0, 1, [1.0, 0.0], ["go"], 5)], "qid long, tenant_id long, vector array<double>, terms array<string>, k int")
    assert set(ids(fusion.search(df, both))) == {1, 2}
    assert fusion.search(df, both.select("qid", "tenant_id", "k")).count() == 0
    assert fusion.hybrid(df, both, rerank=lambda x: x.filter("record_id = 2")).count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [(r[0], r[1]) for r in df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.l2_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (pytest.approx(0.96), pytest.approx(math.sqrt(2))) and got[1][0] is None and got[2] == (None, None)


def record(i, text="t", embedding=None, tenant=1):
    return (tenant, i, "Text", 1, "minhash-h128", 1, b"\x01\x02", embedding, None, None, text)


def test_store(spark, tmp_path):
    from decimal import Decimal

    make = lambda *rows: spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:]) for r in rows], records.SCHEMA)
    store = records.Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    store.upsert(make(record(1, embedding=[1.0]), record(2)))
    batch = make(record(1, "first"), record(1, "second")).withColumn("seq", F.monotonically_increasing_id())
    store.upsert(batch, F.col("seq"))
    got = {r.record_id: r for r in store.read().collect()}
    assert got[1].text == "second" and got[1].embedding is None and len(got) == 2
    store.upsert(batch, F.col("seq"))
    assert store.read().count() == 2
    store.delete(make(record(2), record(77)))
    assert [r.record_id for r in store.read().collect()] == [1] and store.read(1).count() == 2
    assert store.prune(2) == [1, 2] and store.versions() == [3, 4]
    assert store.restore(3) == 5 and store.read().count() == 2
    row = records.get(store.read(), 1, 1)
    assert row.fingerprint_bytes == 2 and not row.has_embedding
    with pytest.raises(RecordNotFoundError):
        records.get(store.read(), 1, 99)


def test_tenant_guard():
    records.tenant_guard(0, 5)
    records.tenant_guard(5, 5)
    with pytest.raises(ForbiddenError):
        records.tenant_guard(4, 5)
