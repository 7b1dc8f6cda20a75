"""Queries on scoped search, requests, keys, caches, sessions and names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio, bits, text
from ..operators import bm25, control, fusion, kernels, knn, records, signatures, usage
from ..sources import tables as T
from ..streaming import jobs
from .queries import EVENTS, HYBRID_CTES, MINHASH, ONE, ORACLE_SQL, SIM_IDF, TERMS, TOKENS, _vector_queries, knn_sql, make_queries, queries_sql, query, rounded, scores_sql, top_sql

# ---------------------------------------------------------------- search

SCOPED = scores_sql(queries_sql(ONE)) + ", s2 AS (SELECT * FROM s WHERE record_id % 3 = 0 AND record_id % 8 <> 4)"


@query("bm25_scoped", top_sql(SCOPED).replace("FROM s GROUP", "FROM s2 GROUP"))
def _(spark, d):
    own = T.text_records(spark, d).withColumn("modality", F.when(F.col("record_id") % 8 == 4, "Image").otherwise("Text"))
    return rounded(bm25.search(own, make_queries(spark, ONE), where=F.col("record_id") % 3 == 0, modality="text"), "score")


@query("knn_scoped", knn_sql("record_id % 100 = 0", 5).replace("FROM q JOIN v USING (tenant_id)", "FROM q JOIN v USING (tenant_id) WHERE v.record_id % 3 = 0"))
def _(spark, d):
    return rounded(knn.search(T.vector_records(spark, d), _vector_queries(spark, d, "record_id % 100 = 0", 5), where=F.col("record_id") % 3 == 0), "score")


def _hybrid(spark, d, **settings):
    both = T.text_records(spark, d).join(T.vector_records(spark, d), ["tenant_id", "record_id"], "full")
    return fusion.search(both, _vector_queries(spark, d, "record_id = 0", 10).withColumn("terms", F.array(*map(F.lit, TERMS))), **settings)


RANKED = f"""{HYBRID_CTES}, o AS (SELECT *, coalesce(vector_score, 0) + coalesce(bm25_score, 0) AS score FROM fu),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM o) WHERE rank <= 10)"""


@query("hybrid_term_hits", f"""WITH {RANKED}, h AS (SELECT record_id, CAST(count(*) AS INTEGER) AS n_hits, round(sum(contribution), 6) AS total FROM s GROUP BY record_id)
SELECT top.record_id, rank, CASE WHEN bm25_rank IS NOT NULL THEN n_hits END AS n_hits, CASE WHEN bm25_rank IS NOT NULL THEN total END AS total FROM top LEFT JOIN h USING (record_id)""")
def _(spark, d):
    found = _hybrid(spark, d, explain=True)
    hits = F.when(F.col("terms").isNotNull(), F.size("terms"))
    return rounded(found.select("record_id", "rank", hits.alias("n_hits"), F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["contribution"]).alias("total")), "total")


@query("hits_as_json", f"""WITH {RANKED}, j AS (SELECT rank, '{{"record_id":' || record_id || coalesce(',"vector_rank":' || vector_rank, '') || coalesce(',"bm25_rank":' || bm25_rank, '') || ',"rank":' || rank || '}}' AS hit FROM top)
SELECT CAST(0 AS BIGINT) AS qid, '[' || string_agg(hit, ',' ORDER BY rank) || ']' AS hits FROM j""")
def _(spark, d):
    return fusion.as_json(_hybrid(spark, d).select("qid", "tenant_id", "record_id", "vector_rank", "bm25_rank", "rank"))


@query("search_requests", """SELECT vec_id AS qid, CAST(least(greatest(vec_id % 150 - 20, 1), 100) AS INTEGER) AS k, CASE WHEN vec_id % 10 IN (0, 1, 2) THEN 400 ELSE 200 END AS status FROM embeddings""")
def _(spark, d):
    i = F.col("record_id")
    none = F.array().cast("array<float>")
    broken = F.concat(F.array(F.lit(float("nan")).cast("float")), F.col("embedding"))
    vector = F.when(i % 10 == 1, none).when(i % 10 == 2, broken).when(i % 10 != 0, F.col("embedding"))
    return fusion.requested(T.vector_records(spark, d).select(i.alias("qid"), "tenant_id", vector.alias("vector"), (i % 150 - 20).alias("k"))).select("qid", "k", "status")


# ---------------------------------------------------------------- records

@query("records_page", "SELECT doc_id AS record_id, source || '/' || lang AS label FROM documents WHERE doc_id % 2 = 0 AND contains(lower(source || '/' || lang), '/e') ORDER BY doc_id DESC LIMIT 25")
def _(spark, d):
    label = F.concat("source", F.lit("/"), "lang").alias("label")
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 2 == 0, "Text").otherwise("Image").alias("modality"), label)
    return records.page(docs, "text", "/E").select("record_id", "label")


CONFIGURED = """c AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 7 = 0 THEN 'simhash' ELSE 'minhash' END AS algorithm, 1 + doc_id % 11 // 10 AS format_version, coalesce(lang, '') AS lang FROM documents),
h AS (SELECT *, ('0x' || substring(md5(lang || chr(31) || 'word' || chr(31) || algorithm), 1, 15))::BIGINT AS config_hash FROM c)"""


@query("comparable_records", f"""WITH {CONFIGURED} SELECT a.record_id, a.config_hash, CASE WHEN a.algorithm = b.algorithm AND a.format_version = b.format_version AND a.config_hash = b.config_hash THEN 200 ELSE 409 END AS status
FROM h a JOIN h b ON b.record_id = a.record_id + 1""")
def _(spark, d):
    i = F.col("doc_id")
    algorithm = F.when(i % 7 == 0, "simhash").otherwise("minhash")
    own = F.struct(algorithm.alias("algorithm"), (1 + F.floor(i % 11 / 10)).alias("format_version"), records.config_hash(F.col("lang"), "word", algorithm).alias("config_hash"))
    left = T.read(spark, d, "documents").select(i.alias("record_id"), own.alias("a"))
    pairs = left.join(left.select((F.col("record_id") - 1).alias("record_id"), F.col("a").alias("b")), "record_id")
    return records.compared(pairs).select("record_id", F.col("a.config_hash").cast("long").alias("config_hash"), "status")


@query("queue_status", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    return usage.status_counts(T.read(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("top_tokens", f"""WITH {SIM_IDF}, r AS (SELECT record_id, term, w, row_number() OVER (PARTITION BY record_id ORDER BY round(abs(w), 9) DESC, term) AS nth FROM wt)
SELECT record_id, term, round(w, 6) AS weight, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 32""")
def _(spark, d):
    own = T.text_records(spark, d)
    n_docs = own.filter("text IS NOT NULL").count()
    tf = bm25.term_frequencies(own)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    return rounded(signatures.top_tokens(tf.join(df, "term").select("record_id", "term", (F.col("tf") * idf).alias("weight"))), "weight")


_STRIPPED = ORACLE_SQL["html_to_text"].removeprefix("WITH ").partition("\nSELECT ")[0]
PREPARED = MINHASH.replace(TOKENS, _STRIPPED + r""",
tok AS (SELECT page_id AS record_id, list_transform(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM b)""")


@query("prepared_minhash", f"WITH {PREPARED} SELECT record_id, md5(array_to_string(s, ',')) AS signature_md5 FROM sig")
def _(spark, d):
    made = kernels.prepared(T.read(spark, d, "pages").select(F.col("page_id").alias("record_id"), F.col("html").cast("binary").alias("content")), "html")
    return signatures.signatures(made).select("record_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature_md5"))


@query("inspect_whole")
def _(spark, d):
    made = kernels.inspected(T.text_records(spark, d))
    shown = [F.octet_length("raw").alias("raw_bytes"), F.md5("canonical").alias("canonical_md5"), F.size("tokens").alias("shown"), "n_tokens", "n_shingles", F.md5("fingerprint").alias("fingerprint_md5")]
    return made.select("record_id", *shown, F.col("config_hash").cast("long").alias("config_hash"))


# ---------------------------------------------------------------- keys, caches and sessions

@query("gateway_chain", f"""WITH {EVENTS}, r AS (SELECT id, created_at // 600 AS ts, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 = 1 THEN ' ' WHEN id % 11 = 2 THEN 'x_1' ELSE 'key_' || CAST(id % 40 + 1 AS VARCHAR) END AS token FROM ev),
k AS (SELECT o_orderkey AS key_id, o_custkey AS user_id, 'key_' || CAST(o_orderkey AS VARCHAR) AS token FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'),
a AS (SELECT r.*, k.key_id, k.user_id FROM r LEFT JOIN k USING (token)),
m AS (SELECT *, row_number() OVER (PARTITION BY key_id, ts // 60 ORDER BY ts, id) AS im FROM a WHERE key_id IS NOT NULL),
p AS (SELECT *, sum(CASE WHEN im <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY key_id, ts // 86400 ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS pd FROM m)
SELECT id, key_id, user_id, user_id AS tenant_id, CASE WHEN im > 2 OR pd > 40 THEN 429 ELSE 200 END AS status, CASE WHEN im > 2 THEN 'rate limit exceeded' WHEN pd > 40 THEN 'daily quota exceeded' END AS message,
CAST(greatest(2 - im, 0) AS BIGINT) AS minute_left, CAST(greatest(40 - pd, 0) AS BIGINT) AS day_left FROM p UNION ALL
SELECT id, NULL, NULL, NULL, 401, CASE WHEN token IS NULL OR trim(token) = '' THEN 'missing api key' WHEN NOT starts_with(token, 'key_') THEN 'invalid api key format' ELSE 'invalid or revoked api key' END, NULL, NULL FROM a WHERE key_id IS NULL""")
def _(spark, d):
    i = F.col("id")
    token = F.when(i % 11 == 1, " ").when(i % 11 == 2, "x_1").when(i % 11 != 0, F.concat(F.lit("key_"), (i % 40 + 1).cast("string")))
    asked = T.usage_events(spark, d).select("id", F.floor(F.col("created_at") / 600).alias("ts"), token.alias("token"))
    keys = T.api_keys(spark, d).withColumn("per_minute", F.lit(2)).withColumn("per_day", F.lit(40))
    return control.gateway(asked, keys, T.users(spark, d))


@query("cache_ttl_hits", f"""WITH {EVENTS}, e AS (SELECT event_id, event_type FROM events), x AS (SELECT ev.*, event_type, user_id % 7 AS tenant_id, user_id % 20 AS key FROM ev JOIN e ON event_id = id),
p AS (SELECT tenant_id, key, created_at AS put_at, bool_or(event_type = 'purchase') AS live FROM x WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
g AS (SELECT tenant_id, key, id, created_at AS get_at FROM x WHERE event_type NOT IN ('purchase', 'signup'))
SELECT g.tenant_id, g.key, g.id, get_at AS "at", put_at, coalesce(live AND get_at - put_at < 7200, FALSE) AS hit FROM g ASOF LEFT JOIN p ON g.tenant_id = p.tenant_id AND g.key = p.key AND g.get_at >= p.put_at""")
def _(spark, d):
    kinds = T.read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    own = T.usage_events(spark, d).join(kinds, "id").select((F.col("user_id") % 7).alias("tenant_id"), (F.col("user_id") % 20).alias("key"), "id", F.col("created_at").alias("at"), "event_type")
    put = F.col("event_type").isin("purchase", "signup")
    return control.cache_hits(own.filter(~put), own.filter(put).withColumn("live", F.col("event_type") == "purchase"), 7200)


@query("session_expiry", f"""WITH {EVENTS}, g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < 21601 THEN 0 ELSE 1 END AS fresh FROM ev),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS w FROM g)
SELECT user_id, min(created_at) AS started, max(created_at) + 21601 AS expires, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY user_id, w""")
def _(spark, d):
    visits = T.usage_events(spark, d).select("user_id", F.timestamp_seconds("created_at").alias("ts"))
    return jobs.session_ends(visits, "21601 seconds").select("user_id", F.unix_timestamp("started").alias("started"), F.unix_timestamp("expires").alias("expires"), "n")


@query("body_guard", "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 413 ELSE 200 END AS status FROM documents")
def _(spark, d):
    return control.size_guard(T.read(spark, d, "documents").select("doc_id", "text"), "text", 4096).select("doc_id", "status")


# ---------------------------------------------------------------- numbers and names

@query("clock_fields", f"""WITH {EVENTS} SELECT id, created_at // 60 AS minute, strftime(make_timestamp(created_at * 1000000), '%Y%m%d') AS day_key, 86400 - created_at % 86400 AS to_midnight,
round(id % 500 * 16.0::DOUBLE, 6) AS frame_ms, round(id % 500 * 7.8125::DOUBLE, 6) AS bin_hz FROM ev""")
def _(spark, d):
    own = T.usage_events(spark, d)
    place = F.col("id") % 500
    shown = own.select("id", *[x.alias(n) for n, x in usage.clock(F.col("created_at")).items()], audio.frame_ms(place).alias("frame_ms"), audio.bin_hz(place).alias("bin_hz"))
    return rounded(shown, "frame_ms", "bin_hz")


@query("unpacked_bits", """WITH h AS (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_transform(range(0, 128), lambda i: (('0x' || substring(h, CAST(i // 4 + 1 AS INTEGER), 1))::INT >> CAST(3 - i % 4 AS INTEGER)) & 1) AS b FROM h)
SELECT doc_id, array_to_string(b, '') AS bits, CAST(list_sum(b) AS INTEGER) AS ones FROM b""")
def _(spark, d):
    own = T.read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", bits.unpacked(F.md5("text")).alias("b"))
    return own.select("doc_id", F.array_join(F.col("b").cast("array<string>"), "").alias("bits"), F.aggregate("b", F.lit(0), lambda a, x: a + x.cast("int")).alias("ones"))


@query("demo_fingerprint", """WITH c AS (SELECT doc_id, list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split(source || doc_id, ''), lambda x: x <> ''), lambda x: unicode(x)::BIGINT)) AS p FROM documents WHERE source IS NOT NULL)
SELECT doc_id, list_reduce(p, lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS seed FROM c""")
def _(spark, d):
    return T.read(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", bits.fnv1a(F.concat("source", F.col("doc_id").cast("string"))).alias("seed"))


_DIGIT = "substring('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(({} >> {}) & 31 AS INTEGER) + 1, 1)"
_ULID = " || ".join(_DIGIT.format(v, 5 * i) for v, n in (("ms", 10), ("a", 8), ("b", 8)) for i in range(n - 1, -1, -1))


@query("sortable_ids", f"""WITH {EVENTS}, x AS (SELECT id, created_at * 1000 AS ms, ('0x' || substring(md5(CAST(id AS VARCHAR)), 1, 10))::BIGINT AS a, ('0x' || substring(md5(CAST(id AS VARCHAR)), 11, 10))::BIGINT AS b FROM ev)
SELECT id, {_ULID} AS ulid FROM x""")
def _(spark, d):
    return T.usage_events(spark, d).select("id", text.ulid(F.col("created_at") * 1000, F.col("id").cast("string")).alias("ulid"))
