"""Queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, text, vectors
from ..operators import bm25, control, fusion, knn, records, signatures, usage
from ..sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- shared SQL

TOKENS = r"""tok AS (SELECT doc_id % 4 AS tenant_id, doc_id AS record_id,
  list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM documents)"""
TF = TOKENS + """, tf AS (SELECT tenant_id, record_id, term, count(*) AS tf FROM (SELECT tenant_id, record_id, unnest(words) AS term FROM tok) GROUP BY ALL)"""
EVENTS = """ev AS (SELECT event_id AS id, user_id, user_id % 10 AS api_key_id, CASE WHEN event_type = 'click' THEN 'image'
  WHEN event_type IN ('purchase', 'signup') THEN 'audio' ELSE 'text' END AS modality, CAST(strlen(props) AS BIGINT) AS bytes_in,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, ts FROM events)"""
SINCE = 1_704_758_400  # 2024-01-09
TERMS = ("the", "ing", "de")


def scores_sql(queries: str, where: str = "TRUE", docs: str = TF) -> str:
    """CTEs up to `s` (qid, tenant_id, k, record_id, term, idf, tf, contribution). queries: rows qid, tenant_id, term, times, k."""
    return f"""{docs}, q AS ({queries}), d AS (SELECT * FROM tok WHERE {where}), f AS (SELECT * FROM tf WHERE {where}),
st AS (SELECT tenant_id, count(*) AS n_docs, avg(len(words)::DOUBLE) AS avgdl FROM d GROUP BY tenant_id),
df AS (SELECT tenant_id, term, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT q.qid, q.tenant_id, q.k, f.record_id, f.term, ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE) + 1) AS idf, f.tf,
  q.times * ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE) + 1) * f.tf * 2.2::DOUBLE
  / greatest(f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.words) / greatest(avgdl, 1.0::DOUBLE)), 1e-6::DOUBLE) AS contribution
  FROM q JOIN f ON q.tenant_id = f.tenant_id AND q.term = f.term JOIN df ON df.tenant_id = f.tenant_id AND df.term = f.term
  JOIN st ON st.tenant_id = f.tenant_id JOIN d ON d.record_id = f.record_id)"""


def top_sql(ctes: str) -> str:
    return f"""WITH {ctes}, t AS (SELECT qid, tenant_id, k, record_id, sum(contribution) AS score FROM s GROUP BY ALL)
SELECT qid, tenant_id, record_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) AS rank FROM t) WHERE rank <= k"""


def queries_sql(rows: list[tuple]) -> str:
    """VALUES of (qid, tenant, terms, k)."""
    out = [f"({q}, {t}, '{w}', {terms.count(w)}, {k})" for q, t, terms, k in rows for w in dict.fromkeys(terms)]
    return f"SELECT * FROM (VALUES {', '.join(out)}) AS v(qid, tenant_id, term, times, k)"


def make_queries(spark, rows: list[tuple]):
    return spark.createDataFrame([(q, t, list(terms), k) for q, t, terms, k in rows], "qid long, tenant_id long, terms array<string>, k int")


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- index statistics

@query("tokenize_tf", f"WITH {TF} SELECT tenant_id, record_id, term, CAST(tf AS BIGINT) AS tf FROM tf")
def _(spark, d):
    return bm25.term_frequencies(T.text_records(spark, d))


@query("doc_lens", f"WITH {TOKENS} SELECT tenant_id, record_id, CAST(len(words) AS BIGINT) AS dl FROM tok")
def _(spark, d):
    return bm25.document_lengths(T.text_records(spark, d))


@query("corpus_stats", f"WITH {TOKENS} SELECT tenant_id, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS total_len, round(avg(len(words)::DOUBLE), 6) AS avgdl FROM tok GROUP BY tenant_id")
def _(spark, d):
    return rounded(bm25.corpus_stats(T.text_records(spark, d)), "avgdl")


@query("doc_freq", f"WITH {TF} SELECT tenant_id, term, CAST(count(*) AS BIGINT) AS n FROM tf GROUP BY ALL")
def _(spark, d):
    return bm25.document_frequencies(T.text_records(spark, d))


@query("term_dictionary", f"WITH {TF} SELECT DISTINCT tenant_id, term FROM tf")
def _(spark, d):
    return bm25.term_dictionary(T.text_records(spark, d))


@query("posting_list", f"WITH {TF} SELECT record_id, CAST(tf AS BIGINT) AS tf FROM tf WHERE tenant_id = 1 AND term = 'the'")
def _(spark, d):
    return bm25.term_frequencies(T.text_records(spark, d).filter("tenant_id = 1")).filter("term = 'the'").select("record_id", "tf")


# ---------------------------------------------------------------- BM25

ONE = [(0, 0, TERMS, 10)]
MANY = [(i, i % 4, (w, "of", "und"), 5) for i, w in enumerate(("the", "que", "die", "and", "in", "la", "ing", "er"))]
TWICE = [(0, 1, ("the", "the", "of"), 10)]


@query("bm25_topk", top_sql(scores_sql(queries_sql(ONE))))
def _(spark, d):
    return rounded(bm25.search(T.text_records(spark, d), make_queries(spark, ONE)), "score")


@query("bm25_multi_query", top_sql(scores_sql(queries_sql(MANY))))
def _(spark, d):
    return rounded(bm25.search(T.text_records(spark, d), make_queries(spark, MANY)), "score")


@query("bm25_duplicate_terms", top_sql(scores_sql(queries_sql(TWICE))))
def _(spark, d):
    return rounded(bm25.search(T.text_records(spark, d), make_queries(spark, TWICE)), "score")


@query("bm25_unknown_term", top_sql(scores_sql(queries_sql([(0, 0, ("nosuchword",), 10)]))))
def _(spark, d):
    return rounded(bm25.search(T.text_records(spark, d), make_queries(spark, [(0, 0, ("nosuchword",), 10)])), "score")


EXPLAIN_SQL = f"""WITH {scores_sql(queries_sql(ONE))}, t AS (SELECT qid, record_id, k, sum(contribution) AS score FROM s GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) AS rank FROM t) WHERE rank <= k)
SELECT record_id, CAST(rank AS INTEGER) AS rank, term, round(idf, 6) AS idf, CAST(tf AS BIGINT) AS tf, round(contribution, 6) AS contribution FROM b JOIN s USING (qid, record_id)"""


@query("bm25_explain_terms", EXPLAIN_SQL)
def _(spark, d):
    found = bm25.search(T.text_records(spark, d), make_queries(spark, ONE), explain=True)
    return rounded(found.select("record_id", "rank", F.inline("terms")), "idf", "contribution")


@query("bm25_after_delete", top_sql(scores_sql(queries_sql(ONE), "record_id % 7 <> 0")))
def _(spark, d):
    old = T.text_records(spark, d)
    return rounded(bm25.search(records.delete(old, old.filter("record_id % 7 = 0")), make_queries(spark, ONE)), "score")


@query("bm25_after_reupsert", top_sql(scores_sql(queries_sql(ONE), docs=TF.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'the new text of the record' ELSE text END AS text FROM documents)"))))
def _(spark, d):
    old = T.text_records(spark, d)
    new = old.filter("record_id % 5 = 0").withColumn("text", F.lit("the new text of the record"))
    return rounded(bm25.search(records.upsert(old, new), make_queries(spark, ONE)), "score")


# ---------------------------------------------------------------- vectors

VEC = "v AS (SELECT vec_id % 4 AS tenant_id, vec_id AS record_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def knn_sql(which: str, k: int, score: str = "list_cosine_similarity(q.e, v.e)") -> str:
    return f"""WITH {VEC}, q AS (SELECT record_id AS qid, tenant_id, e FROM v WHERE {which}),
t AS (SELECT qid, v.tenant_id, v.record_id, {score} AS score FROM q JOIN v USING (tenant_id))
SELECT qid, tenant_id, record_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) AS rank FROM t) WHERE rank <= {k}"""


def _vector_queries(spark, d, which: str, k: int):
    return T.vector_records(spark, d).filter(which).select(F.col("record_id").alias("qid"), "tenant_id", F.col("embedding").alias("vector"), F.lit(k).alias("k"))


@query("knn_cosine_topk", knn_sql("record_id = 0", 10))
def _(spark, d):
    return rounded(knn.search(T.vector_records(spark, d), _vector_queries(spark, d, "record_id = 0", 10)), "score")


@query("knn_batch", knn_sql("record_id % 100 = 0", 5))
def _(spark, d):
    return rounded(knn.search(T.vector_records(spark, d), _vector_queries(spark, d, "record_id % 100 = 0", 5)), "score")


@query("l2_topk", knn_sql("record_id = 3", 10, "0 - list_distance(q.e, v.e)"))
def _(spark, d):
    return rounded(knn.search(T.vector_records(spark, d), _vector_queries(spark, d, "record_id = 3", 10), "l2"), "score")


@query("knn_dim_mismatch", f"WITH {VEC} SELECT 0 AS qid, tenant_id, record_id, 0.0 AS score, 0 AS rank FROM v WHERE FALSE")
def _(spark, d):
    short = _vector_queries(spark, d, "record_id = 0", 10).withColumn("vector", F.slice("vector", 1, 3))
    return knn.search(T.vector_records(spark, d), short)


@query("vector_stats", f"""WITH {VEC} SELECT record_id, CAST(len(e) AS INTEGER) AS dim, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2,
round(list_min(e), 6) AS lo, round(list_max(e), 6) AS hi, round(list_sum(e) / len(e), 6) AS mean FROM v""")
def _(spark, d):
    e = F.col("embedding").cast("array<double>")
    mean = F.aggregate(e, F.lit(0.0), lambda a, b: a + b) / F.size(e)
    out = T.vector_records(spark, d).select("record_id", F.size(e).alias("dim"), vectors.norm(e).alias("l2"), F.array_min(e).alias("lo"), F.array_max(e).alias("hi"), mean.alias("mean"))
    return rounded(out, "l2", "lo", "hi", "mean")


@query("vector_pairs", f"""WITH {VEC} SELECT a.record_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS l2
FROM v a JOIN v b ON b.record_id = a.record_id + 1""")
def _(spark, d):
    a = T.vector_records(spark, d)
    b = a.select((F.col("record_id") - 1).alias("record_id"), F.col("embedding").alias("other"))
    return rounded(a.join(b, "record_id").select("record_id", vectors.cosine(F.col("embedding"), F.col("other")).alias("cosine"), vectors.l2_distance(F.col("embedding"), F.col("other")).alias("l2")), "cosine", "l2")


# ---------------------------------------------------------------- fusion

HYBRID_CTES = f"""{scores_sql(queries_sql([(0, 0, TERMS, 10)]))}, {VEC},
bt AS (SELECT record_id, sum(contribution) AS score FROM s GROUP BY ALL),
br AS (SELECT record_id, rank FROM (SELECT record_id, row_number() OVER (ORDER BY score DESC, record_id) AS rank FROM bt) WHERE rank <= 10),
vt AS (SELECT v.record_id, list_cosine_similarity(x.e, v.e) AS score FROM v JOIN v x ON x.record_id = 0 AND x.tenant_id = v.tenant_id),
vr AS (SELECT record_id, rank FROM (SELECT record_id, row_number() OVER (ORDER BY score DESC, record_id) AS rank FROM vt) WHERE rank <= 10),
fu AS (SELECT coalesce(vr.record_id, br.record_id) AS record_id, 1.0::DOUBLE / (60 + vr.rank) AS vector_score, 1.0::DOUBLE / (60 + br.rank) AS bm25_score,
  CAST(vr.rank AS INTEGER) AS vector_rank, CAST(br.rank AS INTEGER) AS bm25_rank FROM vr FULL OUTER JOIN br ON vr.record_id = br.record_id)"""
HYBRID_SQL = f"""WITH {HYBRID_CTES}, o AS (SELECT *, coalesce(vector_score, 0) + coalesce(bm25_score, 0) AS score FROM fu)
SELECT record_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, vector_rank, bm25_rank, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, record_id) AS rank FROM o) WHERE rank <= 10"""


@query("hybrid_search", HYBRID_SQL)
def _(spark, d):
    both = T.text_records(spark, d).join(T.vector_records(spark, d), ["tenant_id", "record_id"], "full")
    q = _vector_queries(spark, d, "record_id = 0", 10).withColumn("terms", F.array(*map(F.lit, TERMS)))
    return rounded(fusion.search(both, q), "score", "vector_score", "bm25_score").drop("qid", "tenant_id")


# ---------------------------------------------------------------- signatures

SHINGLES = TOKENS + r""", w AS (SELECT record_id, len(words) AS m, unnest(words) AS x, generate_subscripts(words, 1) AS p FROM tok),
g AS (SELECT record_id, m, p, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS t FROM w WINDOW o AS (PARTITION BY record_id ORDER BY p)),
sh AS (SELECT DISTINCT record_id, t AS shingle FROM g WHERE p <= greatest(1, m - 4))"""
MINHASH = SHINGLES + """, h AS (SELECT record_id, ('0x' || substring(md5(shingle), 1, 13))::BIGINT AS h1, ('0x' || substring(md5(shingle), 14, 13))::BIGINT AS h2 FROM sh),
mh AS (SELECT record_id, i AS slot, min((h1 + i * h2) & 4503599627370495) AS value FROM h, range(128) r(i) GROUP BY ALL),
sig AS (SELECT record_id, list(value ORDER BY slot) AS s FROM mh GROUP BY record_id)"""
LSH = MINHASH + """, fst AS (SELECT s, min(record_id) AS record_id FROM sig GROUP BY s),
bd AS (SELECT record_id, b, s[b * 8 + 1:b * 8 + 8] AS k FROM fst, range(16) r(b)),
cand AS (SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM bd x JOIN bd y ON x.b = y.b AND x.k = y.k AND x.record_id < y.record_id)"""


@query("shingles_k5", f"WITH {SHINGLES} SELECT record_id, shingle FROM sh")
def _(spark, d):
    return signatures.shingle_rows(T.text_records(spark, d))


@query("minhash_signature", f"WITH {MINHASH} SELECT record_id, md5(array_to_string(s, ',')) AS signature_md5, s[1] AS first_slot FROM sig")
def _(spark, d):
    signed = signatures.signatures(T.text_records(spark, d))
    return signed.select("record_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature_md5"), F.get("signature", F.lit(0)).alias("first_slot"))


@query("lsh_candidates", f"WITH {LSH} SELECT a, b FROM cand")
def _(spark, d):
    return signatures.lsh_candidates(signatures.signatures(T.text_records(spark, d)))


@query("lsh_verified_dups", f"""WITH {LSH}, e AS (SELECT a, b, list_sum(list_transform(range(1, 129), lambda i: (x.s[i] = y.s[i])::INT)) / 128.0::DOUBLE AS estimate
FROM cand JOIN sig x ON x.record_id = a JOIN sig y ON y.record_id = b) SELECT a, b, round(estimate, 6) AS estimate FROM e WHERE estimate >= 0.8""")
def _(spark, d):
    return rounded(signatures.lsh_near_duplicates(T.text_records(spark, d)), "estimate")


@query("lsh_classes", f"WITH {MINHASH} SELECT record_id, min(record_id) OVER (PARTITION BY s) AS representative FROM sig")
def _(spark, d):
    return signatures.signature_classes(signatures.signatures(T.text_records(spark, d)))


SIM = """b AS (SELECT i FROM range(32) r(i)), hs AS (SELECT record_id, w, ('0x' || substring(md5(term), 1, 8))::BIGINT AS hi, ('0x' || substring(md5(term), 9, 8))::BIGINT AS lo FROM wt),
sums AS (SELECT record_id, i, sum(CASE WHEN (hi >> i) & 1 = 1 THEN w ELSE -w END) AS a, sum(CASE WHEN (lo >> i) & 1 = 1 THEN w ELSE -w END) AS c FROM hs, b GROUP BY ALL),
fp AS (SELECT record_id, CAST(sum(CASE WHEN round(a, 6) > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN round(c, 6) > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS lo FROM sums GROUP BY record_id)"""
SIM_TF = f"{TF}, wt AS (SELECT record_id, term, tf::DOUBLE AS w FROM tf), {SIM}"
SIM_IDF = f"""{TF}, nd AS (SELECT count(*) AS n_docs FROM tok), dfr AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
wt AS (SELECT record_id, term, tf * ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE) + 1) AS w FROM tf JOIN dfr USING (term), nd), {SIM}"""


@query("simhash_tf", f"WITH {SIM_TF} SELECT record_id, hi, lo FROM fp")
def _(spark, d):
    return signatures.simhash(T.text_records(spark, d))


@query("simhash_idf", f"WITH {SIM_IDF} SELECT record_id, hi, lo FROM fp")
def _(spark, d):
    own = T.text_records(spark, d)
    n_docs = own.filter("text IS NOT NULL").count()
    df = bm25.document_frequencies(own).groupBy("term").agg(F.sum("n").alias("n"))
    return signatures.simhash(own, df.select("term", F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1).alias("idf")))


@query("simhash_hamming_pairs", f"""WITH {SIM_TF}, u AS (SELECT hi, lo, min(record_id) AS record_id FROM fp GROUP BY hi, lo)
SELECT x.record_id AS a, y.record_id AS b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INTEGER) AS distance FROM u x JOIN u y ON x.record_id < y.record_id
WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 3""")
def _(spark, d):
    return signatures.simhash_pairs(signatures.simhash(T.text_records(spark, d)))


@query("simhash_classes", f"WITH {SIM_TF} SELECT record_id, min(record_id) OVER (PARTITION BY hi, lo) AS representative FROM fp")
def _(spark, d):
    return signatures.simhash_classes(signatures.simhash(T.text_records(spark, d)))


@query("exact_dup_groups", "SELECT sha256(text) AS fingerprint, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return signatures.exact_groups(T.text_records(spark, d).filter("text IS NOT NULL"))


@query("dedup_keep_first", "SELECT min(doc_id) AS record_id, min(doc_id) % 4 AS tenant_id FROM documents GROUP BY text")
def _(spark, d):
    return signatures.keep_first(T.text_records(spark, d)).select("record_id", "tenant_id")


@query("stream_chunks_minhash", """WITH c AS (SELECT conv_id AS record_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id),
tok AS (SELECT record_id, list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM c)""" + MINHASH.removeprefix(TOKENS) + " SELECT record_id, md5(array_to_string(s, ',')) AS signature_md5 FROM sig")
def _(spark, d):
    chunk = F.struct("turn", "role", "text")
    joined = T.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("record_id")).agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    whole = joined.select("record_id", F.array_join(F.transform("chunks", lambda c: F.coalesce(c["text"], F.lit(""))), "").alias("text"))
    return signatures.signatures(whole).select("record_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature_md5"))


# ---------------------------------------------------------------- record store

REC = """rec AS (SELECT doc_id % 4 AS tenant_id, doc_id AS record_id, text, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


def _records(spark, d):
    own = T.text_records(spark, d).join(T.vector_records(spark, d).drop("tenant_id"), "record_id", "left")
    absent = {"modality": F.lit("Text"), "format_version": F.lit(1).cast("long"), "algorithm": F.lit("minhash-h128"), "config_hash": F.lit(1).cast("decimal(20,0)"), "model_id": F.lit(None).cast("string"), "metadata": F.lit(None).cast("binary")}
    return own.withColumns(absent).withColumn("fingerprint", F.unhex(F.md5("text"))).select(*[f.name for f in records.SCHEMA])


DESCRIBE = "'Text' AS modality, 'minhash-h128' AS algorithm, 1::BIGINT AS format_version, 16 AS fingerprint_bytes, embedding IS NOT NULL AS has_embedding, CAST(len(embedding) AS INTEGER) AS embedding_dim, 0 AS metadata_bytes, text IS NOT NULL AS has_text"


@query("describe_record", f"WITH {REC} SELECT tenant_id, record_id, {DESCRIBE} FROM rec WHERE tenant_id = 1 AND record_id = 5")
def _(spark, d):
    return records.describe(_records(spark, d).filter("tenant_id = 1 AND record_id = 5"))


@query("tenant_scan", f"WITH {REC} SELECT tenant_id, record_id, {DESCRIBE} FROM rec WHERE tenant_id = 2")
def _(spark, d):
    return records.describe(_records(spark, d).filter("tenant_id = 2"))


@query("upsert_latest_wins", f"""WITH {REC}, n AS (SELECT tenant_id, record_id, 'second' AS text, NULL::FLOAT[] AS embedding FROM rec WHERE record_id % 3 = 0),
a AS (SELECT * FROM rec ANTI JOIN n USING (tenant_id, record_id) UNION ALL SELECT * FROM n) SELECT tenant_id, record_id, md5(text) AS text_md5, {DESCRIBE.replace(' AS metadata_bytes', ' AS metadata_bytes')} FROM a""")
def _(spark, d):
    old = _records(spark, d)
    some = old.filter("record_id % 3 = 0").withColumn("embedding", F.lit(None).cast("array<float>"))
    batch = some.withColumn("text", F.lit("first")).withColumn("seq", F.lit(0)).unionByName(some.withColumn("text", F.lit("second")).withColumn("seq", F.lit(1)))
    new = records.upsert(old, batch, F.col("seq"))
    return records.describe(new).join(new.select("tenant_id", "record_id", F.md5("text").alias("text_md5")), records.KEY)


@query("delete_anti_join", f"WITH {REC} SELECT tenant_id, record_id FROM rec WHERE record_id % 10 <> 0")
def _(spark, d):
    old = _records(spark, d)
    return records.delete(old, old.filter("record_id % 10 = 0")).select(*records.KEY)


@query("ingest_response", "SELECT doc_id % 4 AS tenant_id, doc_id AS record_id, 'minhash-h128' AS algorithm, md5(text) AS fingerprint_hex, 16 AS fingerprint_bytes FROM documents")
def _(spark, d):
    return records.ingest_response(_records(spark, d))


@query("tenant_guard", "SELECT doc_id AS id, doc_id % 3 AS key_tenant, doc_id % 4 AS path_tenant, CASE WHEN doc_id % 3 <> 0 AND doc_id % 3 <> doc_id % 4 THEN 403 ELSE 200 END AS status FROM documents")
def _(spark, d):
    asked = T.read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("key_tenant"), (F.col("doc_id") % 4).alias("path_tenant"))
    return records.guarded(asked)


@query("fk_cascade", "SELECT o_orderkey AS key_id, o_custkey AS user_id FROM orders WHERE o_custkey % 5 <> 0")
def _(spark, d):
    gone = T.users(spark, d).filter("user_id % 5 = 0").select("user_id")
    return T.api_keys(spark, d).select("key_id", "user_id").join(gone, "user_id", "left_anti").select("key_id", "user_id")


@query("fk_set_null", "SELECT event_id AS id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id % 10 END AS api_key_id FROM events")
def _(spark, d):
    held = spark.range(10).filter("id <> 3").select(F.col("id").alias("api_key_id"), F.lit(True).alias("held"))
    return T.usage_events(spark, d).join(F.broadcast(held), "api_key_id", "left").select("id", F.when(F.col("held"), F.col("api_key_id")).alias("api_key_id"))


# ---------------------------------------------------------------- usage

DAY = "CAST(ts AS DATE)"


@query("usage_by_day", f"WITH {EVENTS} SELECT {DAY} AS day, modality, CAST(count(*) AS BIGINT) AS n FROM ev WHERE created_at >= {SINCE} GROUP BY ALL")
def _(spark, d):
    return usage.by_day(T.usage_events(spark, d), SINCE)


COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE modality = '{m}') AS BIGINT) AS {m}" for m in usage.MODALITIES)


@query("usage_summary", f"WITH {EVENTS} SELECT CAST(count(*) AS BIGINT) AS total, {COUNTS}, CAST(count(*) FILTER (WHERE status >= 400) AS BIGINT) AS errors FROM ev WHERE created_at >= {SINCE}")
def _(spark, d):
    return usage.summary(T.usage_events(spark, d), SINCE)


@query("usage_pivot", f"WITH {EVENTS} SELECT {DAY} AS day, {COUNTS} FROM ev WHERE created_at >= {SINCE} GROUP BY ALL")
def _(spark, d):
    return usage.pivot(T.usage_events(spark, d), SINCE)


@query("usage_share", f"WITH {EVENTS} SELECT modality, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST((SELECT count(*) FROM ev) AS DOUBLE), 6) AS share FROM ev GROUP BY modality")
def _(spark, d):
    return rounded(usage.shares(T.usage_events(spark, d)), "share")


@query("usage_recent", f"WITH {EVENTS} SELECT id, modality, status, created_at FROM ev ORDER BY created_at DESC, id DESC LIMIT 25")
def _(spark, d):
    return usage.recent(T.usage_events(spark, d)).select("id", "modality", "status", "created_at")


@query("usage_keyset_page", f"WITH {EVENTS} SELECT id, modality, status FROM ev WHERE id < 900 AND modality = 'text' AND status = 200 ORDER BY id DESC LIMIT 50")
def _(spark, d):
    return usage.page(T.usage_events(spark, d), 900, "text", 200).select("id", "modality", "status")


@query("usage_latency_hist", f"""WITH {EVENTS}, b AS (SELECT modality, status, CASE WHEN latency_ms <= 5 THEN 5.0 WHEN latency_ms <= 10 THEN 10.0 WHEN latency_ms <= 25 THEN 25.0 WHEN latency_ms <= 50 THEN 50.0
WHEN latency_ms <= 100 THEN 100.0 WHEN latency_ms <= 250 THEN 250.0 WHEN latency_ms <= 500 THEN 500.0 WHEN latency_ms <= 1000 THEN 1000.0 END::DOUBLE AS le FROM ev),
n AS (SELECT modality, status, le, count(*) AS n FROM b GROUP BY ALL)
SELECT modality, status, le, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY modality, status ORDER BY le ASC NULLS LAST) AS BIGINT) AS upto FROM n""")
def _(spark, d):
    return usage.latency_histogram(T.usage_events(spark, d))


@query("request_status_rollup", f"WITH {EVENTS} SELECT modality, CAST(status // 100 AS VARCHAR) || 'xx' AS status_class, CAST(count(*) AS BIGINT) AS n, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, round(max(latency_ms), 6) AS max_latency FROM ev GROUP BY ALL")
def _(spark, d):
    return rounded(usage.status_rollup(T.usage_events(spark, d)), "max_latency")


def _requests(spark, d):
    return T.usage_events(spark, d).select(F.col("user_id").alias("key"), F.col("created_at").alias("ts"), "id")


@query("rate_fixed_window", f"""WITH {EVENTS}, s AS (SELECT user_id AS key, created_at AS ts, id, created_at // 3600 AS slot FROM ev)
SELECT *, CAST(row_number() OVER (PARTITION BY key, slot ORDER BY ts, id) AS INTEGER) AS nth, row_number() OVER (PARTITION BY key, slot ORDER BY ts, id) <= 2 AS allowed FROM s""")
def _(spark, d):
    return usage.fixed_window(_requests(spark, d), 2, 3600)


@query("daily_quota", f"""WITH {EVENTS}, u AS (SELECT user_id AS key, {DAY} AS day, count(*) AS used FROM ev GROUP BY ALL)
SELECT key, day, CAST(used AS BIGINT) AS used, CAST(greatest(3 - used, 0) AS BIGINT) AS left, used > 3 AS over FROM u""")
def _(spark, d):
    return usage.quota(_requests(spark, d), 3)


@query("cache_eviction", f"""WITH {EVENTS}, c AS (SELECT user_id % 7 AS tenant_id, id, bytes_in AS bytes, created_at AS "at" FROM ev)
SELECT *, CAST(sum(bytes) OVER w AS BIGINT) AS running, sum(bytes) OVER w <= 2000 AS kept FROM c WINDOW w AS (PARTITION BY tenant_id ORDER BY "at" DESC, id DESC ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    cache = T.usage_events(spark, d).select((F.col("user_id") % 7).alias("tenant_id"), "id", F.col("bytes_in").alias("bytes"), F.col("created_at").alias("at"))
    return usage.evicted(cache, 2000)


@query("retention_keep_last", "SELECT user_id, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def _(spark, d):
    return usage.keep_last(T.usage_events(spark, d).select("user_id", "id"), "user_id", "id", 3)


@query("client_errors", "SELECT substring(text, 1, 256) AS message, substring(source, 1, 256) AS url, substring(lang, 1, 200) AS agent, substring(text, 1, 1024) AS stack FROM documents")
def _(spark, d):
    docs = T.read(spark, d, "documents")
    return usage.client_errors(docs.select(F.col("text").alias("message"), F.col("source").alias("url"), F.col("lang").alias("agent"), F.col("text").alias("stack")))


# ---------------------------------------------------------------- keys

@query("api_key_auth", """WITH r AS (SELECT event_id AS id, sha256('key_' || CAST(event_id AS VARCHAR)) AS h FROM events),
k AS (SELECT o_orderkey AS key_id, o_custkey AS user_id, sha256('key_' || CAST(o_orderkey AS VARCHAR)) AS h, CASE WHEN o_orderkey % 2 = 0 THEN 60 END AS pm FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F')
SELECT id, key_id, user_id, user_id AS tenant_id, CASE WHEN key_id IS NOT NULL THEN coalesce(pm, 600) END AS per_minute, CASE WHEN key_id IS NOT NULL THEN 50000 END AS per_day, CASE WHEN key_id IS NULL THEN 401 ELSE 200 END AS status FROM r LEFT JOIN k USING (h)""")
def _(spark, d):
    asked = T.read(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("key_"), F.col("event_id").cast("string")).alias("token"))
    return control.authenticate(asked, T.api_keys(spark, d), T.users(spark, d))


@query("active_key_count", "SELECT o_custkey AS user_id, CAST(count(*) AS BIGINT) AS n_keys FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def _(spark, d):
    return control.active_keys(T.api_keys(spark, d))


@query("revoke_key", "SELECT o_orderkey AS key_id, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderkey = 1 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 1) THEN 99 END AS revoked_at FROM orders")
def _(spark, d):
    keys = T.api_keys(spark, d)
    owner = keys.filter("key_id = 1").select("user_id").first()
    return control.revoke(keys, 1, owner["user_id"] if owner else None, 99).select("key_id", "revoked_at")


@query("tenant_alloc", "SELECT coalesce(max(c_custkey), 0) + 1 AS next_tenant_id FROM customer")
def _(spark, d):
    return control.next_tenant(T.users(spark, d))


@query("keys_newest_first", "SELECT o_custkey AS user_id, o_orderkey AS key_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS nth FROM orders")
def _(spark, d):
    from pyspark.sql import Window

    return T.api_keys(spark, d).select("user_id", "key_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("key_id"))).alias("nth"))


@query("token_bucket", f"""WITH RECURSIVE {EVENTS}, s AS (SELECT CAST(user_id AS VARCHAR) AS key, id, created_at * 1000 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM ev),
b AS (SELECT key, n, id, 2.0::DOUBLE AS level, ts AS last, TRUE AS allowed FROM s WHERE n = 1 UNION ALL
SELECT key, n, id, CASE WHEN f >= 1 THEN f - 1 ELSE f END AS level, last, f >= 1 AS allowed FROM (SELECT s.key, s.n, s.id, greatest(b.last, s.ts) AS last,
least(3.0::DOUBLE, b.level + greatest(0, s.ts - b.last) / 1000::DOUBLE * 0.0001::DOUBLE) AS f FROM b JOIN s ON s.key = b.key AND s.n = b.n + 1))
SELECT key, id, allowed, CAST(floor(level) AS BIGINT) AS remaining, CAST(CASE WHEN allowed THEN 0 ELSE ceil((1 - level) / 0.0001::DOUBLE * 1000) END AS BIGINT) AS retry_after_ms FROM b""")
def _(spark, d):
    asked = T.usage_events(spark, d).select(F.col("user_id").cast("string").alias("key"), "id", (F.col("created_at") * 1000).alias("ts_ms"), F.lit(1).alias("cost"))
    return control.token_bucket(asked, rps=0.0001, burst=3)


@query("request_classes", """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'ingest' WHEN event_id % 4 = 1 THEN 'query' WHEN event_id % 4 = 2 THEN 'records' ELSE 'other' END AS op,
CASE WHEN event_id % 5 = 0 THEN 401 WHEN event_id % 7 = 0 THEN 429 WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status FROM events""")
def _(spark, d):
    i = F.col("event_id")
    path = F.element_at(F.array(*map(F.lit, ("/v1/ingest/text/1/2", "/v1/query", "/v1/records/1/2", "/healthz"))), (i % 4 + 1).cast("int"))
    asked = T.read(spark, d, "events").select(i.alias("id"), path.alias("path"), (i % 5 != 0).alias("authed"), (i % 7 != 0).alias("allowed"), (i % 11 != 0).alias("ok"))
    return control.classify(asked).select("id", "op", "status")


# ---------------------------------------------------------------- bytes, text and names

HEXES = "hx AS (SELECT doc_id AS record_id, sha256(text) AS h, sha256(text || 'x') AS g FROM documents WHERE text IS NOT NULL)"
NIB = HEXES + ", n AS (SELECT record_id, unnest(range(1, 64, 2)) AS i, h FROM hx), bt AS (SELECT record_id, substring(h, CAST(i AS INTEGER), 2) AS v FROM n)"


def _hexes(spark, d):
    return T.text_records(spark, d).filter("text IS NOT NULL").select("record_id", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("x")), 256).alias("g"))


@query("byte_entropy", f"WITH {NIB}, c AS (SELECT record_id, v, count(*) / 32.0::DOUBLE AS p FROM bt GROUP BY ALL) SELECT record_id, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY record_id")
def _(spark, d):
    return rounded(bits.byte_entropy(_hexes(spark, d), "record_id", "h"), "entropy")


@query("nibble_histogram", f"WITH {NIB} SELECT record_id, CAST(('0x' || substring(v, 1, 1))::INT AS INTEGER) AS nibble, CAST(count(*) AS BIGINT) AS n FROM bt GROUP BY ALL")
def _(spark, d):
    return bits.byte_frequencies(_hexes(spark, d), "record_id", "h", high_nibble=True).withColumnRenamed("value", "nibble")


@query("hamming_distance", f"""WITH {HEXES}, x AS (SELECT record_id, bit_count(xor(('0x' || substring(h, 1, 8))::BIGINT, ('0x' || substring(g, 1, 8))::BIGINT)) AS distance FROM hx)
SELECT record_id, CAST(distance AS INTEGER) AS distance, round(100.0::DOUBLE * (1 - distance / 32.0::DOUBLE), 6) AS match_pct FROM x""")
def _(spark, d):
    a, b = F.substring("h", 1, 8), F.substring("g", 1, 8)
    return rounded(_hexes(spark, d).select("record_id", bits.hamming_hex(a, b).alias("distance"), bits.bit_match(a, b).alias("match_pct")), "match_pct")


_PIECES = " + ".join(f"bit_count(xor(('0x' || substring(h, {i}, 8))::BIGINT, ('0x' || substring(g, {i}, 8))::BIGINT))::INTEGER" for i in range(1, 65, 8))


@query("hamming_whole_digests", f"""WITH {HEXES}, x AS (SELECT record_id, {_PIECES} AS distance FROM hx)
SELECT record_id, distance, round(100.0::DOUBLE * (1 - distance / 256.0::DOUBLE), 6) AS match_pct FROM x""")
def _(spark, d):
    a, b = F.col("h"), F.col("g")
    return rounded(_hexes(spark, d).select("record_id", bits.hamming_hex(a, b).alias("distance"), bits.bit_match(a, b).alias("match_pct")), "match_pct")


@query("landmark_fields", f"""WITH {HEXES}, x AS (SELECT record_id, ('0x' || substring(h, 1, 8))::BIGINT AS l FROM hx)
SELECT record_id, (l >> 23) & 511 AS f_a, (l >> 14) & 511 AS f_b, l & 16383 AS dt FROM x""")
def _(spark, d):
    return _hexes(spark, d).select("record_id", bits.landmark(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("l")).select("record_id", "l.*")


@query("html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f\x0b]+', ' ', 'g')) AS text FROM b""")
def _(spark, d):
    return T.read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("modality_detect", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 5 = 0 THEN 'audio' WHEN page_id % 5 = 1 THEN 'text' END AS modality FROM pages""")
def _(spark, d):
    i = F.col("page_id")
    mime = F.when(i % 3 == 0, "image/png").otherwise("application/octet-stream")
    name = F.when(i % 5 == 0, "a.b.WAV").when(i % 5 == 1, "notes.md").otherwise("archive")
    return T.read(spark, d, "pages").select("page_id", text.modality(mime, name).alias("modality"))


@query("time_ids", "SELECT event_id AS id, ((CAST(floor(epoch(ts)) AS BIGINT) * 1000 - 1704067200000) << 22) | (event_id & 4194303) AS ulid FROM events WHERE ts >= TIMESTAMP '2024-01-01'")
def _(spark, d):
    return T.usage_events(spark, d).filter("created_at >= 1704067200").select("id", text.time_id(F.col("created_at") * 1000, F.col("id")).alias("ulid"))


@query("api_key_tokens", "SELECT doc_id AS record_id, substring(sha256(text), 1, 13) AS prefix, sha256(sha256(text)) AS key_hash, replace(replace(rtrim(base64(encode(text)), '='), '+', '-'), '/', '_') AS b64 FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    token = F.sha2("text", 256)
    flat = F.regexp_replace(text.url_safe_base64(F.col("text").cast("binary")), r"[\r\n]", "")
    return T.text_records(spark, d).filter("text IS NOT NULL").select("record_id", F.substring(token, 1, 13).alias("prefix"), F.sha2(token, 256).alias("key_hash"), flat.alias("b64"))


@query("bearer_tokens", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 't' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'x' WHEN 2 THEN 'x' END AS token FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    auth = F.when(i % 4 == 0, F.concat(F.lit("Bearer  t"), i.cast("string"))).when(i % 4 == 1, "Basic abc").when(i % 4 == 2, "Bearer  ")
    return T.read(spark, d, "documents").select(i.alias("id"), text.bearer(auth, F.when(i % 4 != 3, " x ").otherwise(" ")).alias("token"))


@query("band_probability", "SELECT s, round(1 - pow(1 - pow(s, 8), 16), 6) AS p FROM (SELECT i / 10.0::DOUBLE AS s FROM range(11) r(i))")
def _(spark, d):
    s = F.col("id") / 10.0
    return spark.range(11).select(s.alias("s"), F.round(1 - F.pow(1 - F.pow(s, 8), 16), 6).alias("p"))


# ---------------------------------------------------------------- queries of the other modules

from . import media_queries, more_queries, text_queries  # noqa: E402, F401
