"""Reciprocal rank fusion and the search dispatcher."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite
from . import bm25, knn

RRF_K = 60


def rrf(rankings: dict[str, DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """(qid, tenant_id, record_id, score, vector_score, bm25_score, vector_rank, bm25_rank) of rankings (qid, tenant_id, record_id, rank).

    Sources other than "bm25" count as vector rankings. A record that a ranking repeats keeps its first rank for display; every occurrence adds to the score.
    """
    part = 1.0 / (rrf_k + F.col("rank"))
    both = None
    for source, df in rankings.items():
        own = df.select("qid", "tenant_id", "record_id", F.lit("bm25" if source == "bm25" else "vector").alias("source"), F.col("rank").cast("int").alias("rank"))
        both = own if both is None else both.unionByName(own)
    of = lambda s, x: F.when(F.col("source") == s, x)
    return both.groupBy("qid", "tenant_id", "record_id").agg(
        F.sum(part).alias("score"),
        F.sum(of("vector", part)).alias("vector_score"), F.sum(of("bm25", part)).alias("bm25_score"),
        F.min(of("vector", F.col("rank"))).alias("vector_rank"), F.min(of("bm25", F.col("rank"))).alias("bm25_rank"),
    )


def hybrid(records: DataFrame, queries: DataFrame, rrf_k: int = RRF_K, rerank: Callable[[DataFrame], DataFrame] | None = None, explain: bool = False, where: Column | None = None, modality: str | None = None) -> DataFrame:
    """Each retriever fetches k; the fused list is cut to k, then reranked. With explain, hits that keyword search found carry its terms."""
    words = bm25.search(records, queries, explain, where, modality)
    fused = rrf({"vector": knn.search(records, queries, where=where, modality=modality), "bm25": words}, rrf_k)
    out = bm25.ranked(fused.join(queries.select("qid", "k"), "qid"), queries.agg(F.max("k")).first()[0] or 0)
    if explain:
        out = out.join(words.select("qid", "tenant_id", "record_id", "terms"), ["qid", "tenant_id", "record_id"], "left")
    return rerank(out) if rerank else out


def search(records: DataFrame, queries: DataFrame, **settings) -> DataFrame:
    """Dispatch by the shape of a batch: vectors and terms, vectors, terms, or nothing."""
    has = lambda c: c in queries.columns
    if has("vector") and has("terms"):
        return hybrid(records, queries, **settings)
    if has("vector"):
        return knn.search(records, queries, **settings)
    if has("terms"):
        return bm25.search(records, queries, **settings)
    empty = queries.select("qid", "tenant_id").limit(0)
    return empty.withColumn("record_id", F.lit(0).cast("long")).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))


def requested(asked: DataFrame, least: int = 1, most: int = 100) -> DataFrame:
    """Requests (qid, tenant_id, vector, k) as a query batch: k from `least` to `most` (10 if null), and status 400 for a vector that is null,
    empty or not finite. Only those of status 200 may go on."""
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0) & finite(F.col("vector"))
    k = F.least(F.greatest(F.coalesce(F.col("k"), F.lit(10)), F.lit(least)), F.lit(most)).cast("int")
    return asked.withColumns({"k": k, "status": F.when(F.coalesce(ok, F.lit(False)), 200).otherwise(400)})


def as_json(hits: DataFrame) -> DataFrame:
    """qid, hits: one JSON array a query in the order of rank; null and empty fields of a hit are left out."""
    fields = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in hits.dtypes if c not in ("qid", "tenant_id")]
    own = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.to_json(F.struct(*fields)).alias("hit")))).alias("all"))  # k hits a query
    return own.select("qid", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["hit"]), ","), F.lit("]")).alias("hits"))
