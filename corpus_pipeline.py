"""The corpus pipeline over documents: language ID, line dedup, near duplicates, benchmark decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentprint.llm.byte_bpe import encode_texts
from contentprint.llm.common import cut, only, read, tidy
from contentprint.llm.decontaminate import decontaminate
from contentprint.llm.langid import UNDETERMINED, held_out, predict, train
from contentprint.llm.line_dedup import dedup_lines
from contentprint.llm.ngram_join import one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose likeliest language has a calibrated probability below this are in no known language. Short clean texts can be right at 0.4.
LEAST_SCORE = 0.3

#: Language identification learns from the rows, which SQL can't express.
ORACLE_SQL = None

# All stages take decisions by row, so that rows that share a doc_id, or have none, are documents of their own; repeated rows are equal documents.
# Extra columns go, also where their names clash with those of documents. An empty table stays empty.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose likeliest language isn't LEAST_SCORE likely, go; the rest get the language found.

    Null and empty texts have no letters. Null labels aren't learnt from; without any label all rows go. Of equally likely languages
    that which sorts first holds.
    """
    docs = only(docs, *COLUMNS)
    model = train(docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    found = predict(docs, model)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; documents that have nothing else, or had nothing (null, empty or blank), go.

    Here rows of one doc_id, or without any, count as one document when a line's documents are counted, and keep or lose a line together.
    """
    out = dedup_lines(docs, keep=("lang", "source", "n_chars"))
    out = out.filter(F.length(F.trim("kept")) > 0)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id stays, a null one last; of
    rows with one doc_id that with the smallest hash of its text; of equal rows one. Texts without words are linked with nothing and stay."""
    return one_of_each(docs, COLUMNS, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none."""
    return decontaminate(only(docs, *COLUMNS), read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, as little-endian unsigned 32-bit integers, with their number and the SHA-256 of what they decode to. Null texts have no ids."""
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=("decoded",))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokens", tokens),
]


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tidy(lambda stage=stage, docs=docs: cut(stage(spark, docs, sf_dir)))()
    return STAGES[-1][1](spark, docs, sf_dir)
