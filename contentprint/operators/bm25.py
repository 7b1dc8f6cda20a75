"""Okapi BM25 over records (tenant_id, record_id, text) for a batch of queries (qid, tenant_id, terms, k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
EXPLAINED = 16
#: Query terms up to which they are broadcast.
BROADCAST_TERMS = 100_000


def tokenized(records: DataFrame, *also: Column) -> DataFrame:
    """tenant_id, record_id, words, dl and the columns `also`. Empty texts have length 0 and still count as documents."""
    out = records.filter("text IS NOT NULL").select("tenant_id", "record_id", tokens(F.col("text")).alias("words"), *also)
    return out.withColumn("dl", F.size("words").cast("long"))


def term_frequencies(records: DataFrame) -> DataFrame:
    words = tokenized(records).select("tenant_id", "record_id", F.explode_outer("words").alias("term")).filter("term IS NOT NULL")
    return words.groupBy("tenant_id", "record_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_dictionary(records: DataFrame) -> DataFrame:
    """tenant_id, term in order: every term once, without its postings."""
    words = records.filter("text IS NOT NULL").select("tenant_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return words.distinct().orderBy("tenant_id", "term")


def document_lengths(records: DataFrame) -> DataFrame:
    return tokenized(records).select("tenant_id", "record_id", "dl")


def corpus_stats(records: DataFrame) -> DataFrame:
    return document_lengths(records).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_len"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def document_frequencies(records: DataFrame) -> DataFrame:
    return term_frequencies(records).groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, tenant_id, k, term, times: the terms as the documents' own tokens; a repeated term counts repeatedly."""
    words = queries.select("qid", "tenant_id", "k", F.explode("terms").alias("raw"))
    words = words.select("qid", "tenant_id", "k", F.explode(tokens(F.col("raw"))).alias("term"))
    return words.groupBy("qid", "tenant_id", "k", "term").agg(F.count(F.lit(1)).alias("times"))


def scope(where: Column | None, modality: str | None) -> Column:
    """What a search looks at: a predicate on the records' own columns and, where asked for, one modality. Both are off by default."""
    out = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return out if modality is None else out & (F.lower(F.col("modality")) == modality.lower())


def contributions(records: DataFrame, queries: DataFrame, where: Column | None = None, modality: str | None = None) -> DataFrame:
    """qid, tenant_id, k, record_id, term, idf, tf, contribution for every query term that a document in scope holds.

    Only occurrences of query terms leave the scan: postings of other terms are never shuffled. Frequencies and lengths are those of all
    documents of the tenant, whatever the scope, so that a score doesn't depend on it.
    """
    return _contributions(records, queries, scope(where, modality))[0]


def _contributions(records: DataFrame, queries: DataFrame, within: Column) -> tuple[DataFrame, int]:
    terms = query_terms(queries)
    wanted = terms.select("tenant_id", "term").distinct()
    most = queries.agg(F.max("k")).first()[0] or 0
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = lambda df: F.broadcast(df) if few else df  # noqa: E731  at most as many rows as query terms
    held = tokenized(records, within.alias("within"))
    hits = held.select("tenant_id", "record_id", "dl", "within", F.explode_outer("words").alias("term")).join(small(wanted), ["tenant_id", "term"])
    tf = hits.groupBy("tenant_id", "record_id", "dl", "within", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("n"))
    stats = held.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    length = 1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * length, F.lit(1e-6))
    known = df.join(stats, "tenant_id").withColumn("idf", idf).select("tenant_id", "term", "idf", "avgdl")
    scored = tf.filter("within").join(small(known), ["tenant_id", "term"]).join(small(terms), ["tenant_id", "term"])
    return scored.select("qid", "tenant_id", "k", "record_id", "term", "idf", "tf", weight.alias("contribution")), most


def search(records: DataFrame, queries: DataFrame, explain: bool = False, where: Column | None = None, modality: str | None = None) -> DataFrame:
    """qid, tenant_id, record_id, score, rank of each query's k best; with explain, its strongest terms. Ties go to the smaller record_id.

    where: a predicate on the records' columns; modality: the only one that is searched. Both apply before scoring.
    """
    found, most = _contributions(records, queries, scope(where, modality))
    aggs = [F.sum("contribution").alias("score")]
    if explain:
        hit = F.struct((-F.col("contribution")).alias("order"), "term", "idf", "tf", "contribution")
        aggs.append(F.transform(F.slice(F.sort_array(F.collect_list(hit)), 1, EXPLAINED), lambda x: F.struct(x["term"].alias("term"), x["idf"].alias("idf"), x["tf"].alias("tf"), x["contribution"].alias("contribution"))).alias("terms"))
    return ranked(found.groupBy("qid", "tenant_id", "k", "record_id").agg(*aggs), most)


def ranked(scores: DataFrame, most: int | None = None) -> DataFrame:
    """The k best of each qid by score, ties by record_id, with `rank` from 1. k is the query's own; `most`, no less than any k, lets each task
    keep its own best before they meet."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "record_id")
    out = scores.withColumn("rank", F.row_number().over(best))
    if most is not None:
        out = out.filter(F.col("rank") <= max(1, most))
    return out.filter(F.col("rank") <= F.greatest(F.col("k"), F.lit(0))).drop("k")
