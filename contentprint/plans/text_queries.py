"""Queries on text that need Unicode tables or the wire profile, on the manifest, and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import manifest, text, unicode
from ..operators import fusion, kernels, signatures
from ..sources import tables as T
from ..streaming import jobs
from .queries import query, rounded


@query("canonical_text", "SELECT doc_id AS record_id, md5(lower(nfc_normalize(text))) AS canonical_md5 FROM documents")
def _(spark, d):
    canonical = unicode.canonicalize(form="nfc")
    return T.text_records(spark, d).select("record_id", F.md5(canonical("text")).alias("canonical_md5"))


@query("word_tokens")
def _(spark, d):
    return T.text_records(spark, d).select("record_id", unicode.tokenize("word")("text").alias("w")).select("record_id", F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))


@query("grapheme_tokens", "SELECT doc_id AS record_id, CAST(length_grapheme(nfc_normalize(text)) AS INTEGER) AS n_graphemes FROM documents")
def _(spark, d):
    return T.text_records(spark, d).select("record_id", F.size(unicode.tokenize("grapheme", form="nfc")("text")).alias("n_graphemes"))


@query("truncate_bytes", """WITH c AS (SELECT doc_id AS record_id, text, list_reduce(list_transform(string_split(substring(text, 1, 40), ''), lambda x: strlen(x)), lambda a, b: a + b) AS n FROM documents)
SELECT doc_id AS record_id, CASE WHEN strlen(text) <= 40 THEN text ELSE (SELECT string_agg(ch, '' ORDER BY i) FROM (SELECT ch, i, sum(strlen(ch)) OVER (ORDER BY i) AS upto FROM
(SELECT unnest(string_split(substring(text, 1, 40), '')) AS ch, generate_subscripts(string_split(substring(text, 1, 40), ''), 1) AS i)) WHERE upto <= 40) || '…' END AS short FROM documents""")
def _(spark, d):
    return T.text_records(spark, d).select("record_id", text.truncated(F.col("text"), 40).alias("short"))


@query("markdown_to_text", "SELECT doc_id AS record_id, md5(trim(regexp_replace('Title ' || substring(text, 1, 30) || ' bold link', '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS text_md5 FROM documents WHERE NOT regexp_matches(substring(text, 1, 30), '[*_`#>~\\[\\]!|-]')")
def _(spark, d):
    start = F.substring("text", 1, 30)
    made = F.concat(F.lit("# Title\n"), start, F.lit(" **bold** [link](http://x)"))
    own = T.text_records(spark, d).filter(~start.rlike(r"[*_`#>~\[\]!|-]"))
    return own.select("record_id", F.md5(text.markdown_text(made)).alias("text_md5"))


@query("markdown_whole_text")
def _(spark, d):
    return T.text_records(spark, d).select("record_id", F.md5(text.markdown_text(F.col("text"))).alias("text_md5"))


@query("minhash_wire")
def _(spark, d):
    made = kernels.fingerprint(T.text_records(spark, d), "minhash-h128")
    return made.select("record_id", F.length("fingerprint").alias("n_bytes"), F.lower(F.hex(F.substring("fingerprint", 1, 16))).alias("head"), F.md5("fingerprint").alias("fingerprint_md5"))


@query("simhash_wire")
def _(spark, d):
    return kernels.fingerprint(T.text_records(spark, d), "simhash-b64-tf").select("record_id", F.hex("fingerprint").alias("fingerprint"))


@query("tlsh_neighbours")
def _(spark, d):
    own = kernels.fingerprint(T.text_records(spark, d), "tlsh-128-1").select("record_id", F.decode("fingerprint", "UTF-8").alias("left"))
    pairs = own.join(own.select((F.col("record_id") - 1).alias("record_id"), F.col("left").alias("right")), "record_id")
    return kernels.tlsh_compare(pairs).select("record_id", "distance")


@query("semantic_hashing")
def _(spark, d):
    made = kernels.embed(T.text_records(spark, d), kernels.HashingProvider())
    return rounded(made.select("record_id", "model_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("inspect_text", """WITH w AS (SELECT doc_id AS record_id, text, list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM documents)
SELECT record_id, substring(text, 1, 64) AS raw, CAST(len(words) AS INTEGER) AS n_tokens, CAST(least(len(words), 256) AS INTEGER) AS shown_tokens,
CAST(CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 4, 1) END AS INTEGER) AS n_shingles FROM w""")
def _(spark, d):
    own = T.text_records(spark, d).withColumn("words", text.tokens(F.col("text")))
    return own.select("record_id", F.substring("text", 1, 64).alias("raw"), F.size("words").alias("n_tokens"), F.size(F.slice("words", 1, 256)).alias("shown_tokens"), F.size(text.shingles(F.col("words"), signatures.WORDS)).alias("n_shingles"))


def values_sql(rows: list[tuple], schema: str) -> str:
    """VALUES with the names and types of a schema (name type, ..)."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    fields = [x.split() for x in schema.split(", ")]
    shown = [", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) for row in rows]
    return f"SELECT {', '.join(f'CAST({n} AS {kinds[t]}) AS {n}' for n, t in fields)} FROM (VALUES {', '.join(f'({r})' for r in shown)}) AS v({', '.join(n for n, _ in fields)})"


@query("algorithm_manifest", values_sql(manifest.ALGORITHMS, "modality string, algorithm string, n_bytes int, least_input int, needs_provider boolean"))
def _(spark, d):
    return manifest.algorithms(spark)


@query("algorithm_tunables", values_sql(manifest.TUNABLES, "algorithm string, name string, least double, most double, step double, preset double"))
def _(spark, d):
    return manifest.tunables(spark)


@query("rrf_fuse", """WITH a AS (SELECT doc_id AS record_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id AS record_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents),
x AS (SELECT record_id, r FROM a WHERE r <= 50), y AS (SELECT record_id, r FROM b WHERE r <= 50)
SELECT coalesce(x.record_id, y.record_id) AS record_id, round(coalesce(1.0::DOUBLE / (60 + x.r), 0) + coalesce(1.0::DOUBLE / (60 + y.r), 0), 6) AS score, CAST(x.r AS INTEGER) AS vector_rank, CAST(y.r AS INTEGER) AS bm25_rank FROM x FULL OUTER JOIN y ON x.record_id = y.record_id""")
def _(spark, d):
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "n_chars")

    def top(order, other):
        rows = docs.orderBy(order, "record_id").limit(50).collect()
        return spark.createDataFrame([(0, 0, r["record_id"], i + 1) for i, r in enumerate(rows)], "qid long, tenant_id long, record_id long, rank int")

    out = fusion.rrf({"vector": top(F.desc("n_chars"), None), "bm25": top(F.asc("n_chars"), None)})
    return rounded(out.select("record_id", "score", "vector_rank", "bm25_rank"), "score")


@query("stream_usage_by_day", """SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'click' THEN 'image' WHEN event_type IN ('purchase', 'signup') THEN 'audio' ELSE 'text' END AS modality, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    return jobs.drained(jobs.usage_by_day(jobs.event_stream(spark, d)), "complete")


@query("stream_minhash")
def _(spark, d):
    out = jobs.minhash_sessions(jobs.chunk_stream(spark, d))
    return jobs.drained(out, "update").groupBy("session").agg(F.max_by("fingerprint", "n_chunks").alias("f"), F.max("n_chunks").alias("n_chunks")).select("session", "n_chunks", F.md5("f").alias("fingerprint_md5"))


@query("stream_session_sizes", "SELECT CAST(conv_id AS VARCHAR) AS session, CAST(count(*) AS BIGINT) AS n_chunks FROM conversations GROUP BY conv_id")
def _(spark, d):
    out = jobs.minhash_sessions(jobs.chunk_stream(spark, d))
    return jobs.drained(out, "update").groupBy("session").agg(F.max("n_chunks").alias("n_chunks"))
