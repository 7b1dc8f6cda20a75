"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_texts
from .common import read
from .cotrain import score_quality
from .decontaminate import contaminations
from .fingerprints import compare_neighbours
from .html_text import extract_text
from .langid import identify
from .line_dedup import dedup_lines
from .ngram_join import link_documents
from .token_counts import count_tokens
from .warc import derive, responses


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(read(spark, sf_dir, "pages")))
    return made.withColumn("text", F.when(F.col("warc_type") == "conversion", F.decode("block", "UTF-8"))).withColumn("block_sha256", F.sha2("block", 256)).drop("block")


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "start_word", F.round("similarity", 6).alias("similarity"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
rep AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.doc_id, a.line, a.pos, (r.k IS NOT NULL AND r.owner <> a.doc_id) AS gone FROM keyed a LEFT JOIN rep r ON a.k = r.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
de AS (SELECT doc_id, p, concat_ws(' ', w, w1, w2, w3, w4) AS t FROM (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2,
  lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE w4 IS NOT NULL),
dn AS (SELECT doc_id, count(*) AS m FROM de GROUP BY doc_id),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM b),
be AS (SELECT DISTINCT item_id, n, concat_ws(' ', w, w1, w2, w3, w4) AS t FROM (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2,
  lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM bw WINDOW o AS (PARTITION BY item_id ORDER BY p)) WHERE w4 IS NOT NULL),
span AS (SELECT doc_id, item_id, n, min(p) AS lo, max(p) AS hi FROM de JOIN be USING (t) GROUP BY ALL),
st AS (SELECT s.doc_id, item_id, n, unnest(range(greatest(0, lo - (n - 5)), least(hi, greatest(0, m - (n - 4))) + 1)) AS start_word FROM span s JOIN dn USING (doc_id)),
win AS (SELECT DISTINCT st.doc_id, item_id, n, start_word, t FROM st JOIN de ON de.doc_id = st.doc_id AND de.p BETWEEN start_word AND start_word + n - 5),
wt AS (SELECT t, 1 + len(list_filter(string_split(t, ' '), lambda y: length(y) >= 6)) AS w FROM (SELECT t FROM win UNION SELECT t FROM be)),
o AS (SELECT item_id, sum(w) AS o FROM be JOIN wt USING (t) GROUP BY item_id),
scored AS (SELECT doc_id, win.item_id, win.n, start_word, sum(w) AS a, coalesce(sum(w) FILTER (WHERE be.t IS NOT NULL), 0) AS c
  FROM win JOIN wt USING (t) LEFT JOIN be ON be.item_id = win.item_id AND be.t = win.t GROUP BY ALL),
good AS (SELECT s.*, CAST(c AS DOUBLE) / CAST(a + o - c AS DOUBLE) AS sim FROM scored s JOIN o USING (item_id) WHERE c * 100 >= (a + o - c) * 80)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_words, CAST(start_word AS INTEGER) AS start_word, round(sim, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start_word) AS r FROM good) WHERE r = 1
"""

NGRAM_JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
q AS (SELECT doc_id, m, p, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS t FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
t AS (SELECT DISTINCT doc_id, t FROM q WHERE p <= greatest(1, m - 3)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
l2 AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l2.y FROM r JOIN l2 ON r.reached = l2.x),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""

# The article of a generated page: what lies between its tags, where h1, p and br part blocks and other tags part nothing.
EXTRACTION_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, t AS text, CAST(length(t) AS BIGINT) AS n_chars FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_quality_cotraining": op2_quality_cotraining,
    "op3_decontamination": op3_decontamination,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": DECONTAMINATION_SQL, "op5_html_extraction": EXTRACTION_SQL, "op8_ngram_join": NGRAM_JOIN_SQL, "op10_line_dedup": LINE_DEDUP_SQL}
