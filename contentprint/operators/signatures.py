"""MinHash, SimHash and what is found with them, over (record_id, text).

The portable profile takes its hashes from MD5, so that any SQL engine can repeat it. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles, tokens
from ..scratch import cut, tidy

SLOTS, WORDS = 128, 5
BANDS, ROWS = 16, 8
_MASK = (1 << 52) - 1


def _hex(digest: Column, first: int, n: int) -> Column:
    return F.conv(F.substring(digest, first, n), 16, 10).cast("long")


def shingle_rows(records: DataFrame, k: int = WORDS) -> DataFrame:
    """record_id, shingle: the distinct shingles of each text."""
    words = records.select("record_id", tokens(F.col("text")).alias("words"))
    runs = words.select("record_id", shingles(F.col("words"), k).alias("runs"))
    # the outer form: for the other Spark infers a filter on the array, for which it would be made twice
    return runs.select("record_id", F.explode_outer(F.array_distinct("runs")).alias("shingle")).filter("shingle IS NOT NULL")


def _minima(runs: list[str], slots: int) -> np.ndarray:
    """For each slot i the least (h1 + i h2) mod 2^52 over the shingles; h1 and h2 are the first and second 13 hexadecimal digits of their MD5."""
    digests = np.frombuffer(b"".join([hashlib.md5(x.encode()).digest() for x in runs]), ">u8").astype(np.uint64).reshape(-1, 2)
    h1 = digests[:, 0] >> np.uint64(12)
    h2 = (digests[:, 0] & np.uint64(0xFFF)) << np.uint64(40) | digests[:, 1] >> np.uint64(24)
    steps, mask, out = np.arange(slots, dtype=np.uint64)[:, None], np.uint64(_MASK), None
    for at in range(0, len(h1), 2048):  # bounded rows at a time
        own = ((h1[at : at + 2048] + steps * h2[at : at + 2048]) & mask).min(axis=1)
        out = own if out is None else np.minimum(out, own)
    return out


def signatures(records: DataFrame, k: int = WORDS, slots: int = SLOTS) -> DataFrame:
    """record_id, signature (array of `slots` minima) of every record with a word.

    Words are taken in the JVM; shingles and minima in one Arrow function, so that neither a row a shingle nor a shuffle comes about. The values are
    those of min((h1 + i * h2) & (2^52 - 1)) over the shingles in any SQL engine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for joined in batch["words"].to_pylist():
                words = joined.split(" ")
                made.append(_minima(list({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}), slots))
            flat = np.concatenate(made).astype(np.int64) if made else np.empty(0, np.int64)
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * slots)
            yield pa.record_batch({"record_id": batch["record_id"], "signature": pa.ListArray.from_arrays(ends, pa.array(flat))})

    words = records.select("record_id", F.array_join(tokens(F.col("text")), " ").alias("words")).filter("words <> ''")
    return words.mapInArrow(run, f"record_id {dict(records.dtypes)['record_id']}, signature array<long>")


def jaccard_estimate(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda p, q: p + q) / F.size(a)


def bands(signed: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """record_id, band, bucket for (record_id, signature)."""
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.md5(F.array_join(F.slice("signature", b * rows + 1, rows).cast("array<string>"), ",")).alias("bucket")) for b in range(n_bands)])
    return signed.select("record_id", F.inline(each))


def _classes(rows: DataFrame, *key: str) -> DataFrame:
    least = rows.groupBy(*key).agg(F.min("record_id").alias("representative"))
    return rows.select("record_id", *key).join(least, list(key)).select("record_id", "representative")


def signature_classes(signed: DataFrame) -> DataFrame:
    """record_id, representative: for each record the smallest one of its signature, which stands for it in the pairs; also where that is in no pair."""
    return _classes(signed, "signature")


def simhash_classes(hashed: DataFrame) -> DataFrame:
    """record_id, representative: for each record the smallest one of its fingerprint (distance 0), which stands for it in simhash_pairs()."""
    return _classes(hashed, "hi", "lo")


def lsh_candidates(signed: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs a < b that share a bucket in some band. Of the records with one signature the smallest stands for all: see signature_classes()."""
    first = signed.groupBy("signature").agg(F.min("record_id").alias("record_id"))
    buckets = bands(first, n_bands, rows)
    left, right = buckets.withColumnRenamed("record_id", "a"), buckets.withColumnRenamed("record_id", "b")
    return left.join(right, ["band", "bucket"]).filter("a < b").select("a", "b").distinct()


@tidy
def lsh_near_duplicates(records: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b, estimate of the pairs of different signatures that agree in `threshold` of the slots; signature_classes() tells for whom a and b stand.

    16 bands of 8 slots meet a pair of similarity s with a probability of 1 - (1 - s^8)^16: 0.95 at 0.8, 0.9995 at 0.9. Signatures are written once.
    """
    signed = cut(signatures(records))
    of = lambda x: signed.select(F.col("record_id").alias(x), F.col("signature").alias(f"s{x}"))
    pairs = lsh_candidates(signed).join(of("a"), "a").join(of("b"), "b")
    return pairs.select("a", "b", jaccard_estimate(F.col("sa"), F.col("sb")).alias("estimate")).filter(F.col("estimate") >= threshold)


def simhash(records: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """record_id, hi, lo: 64 bits as two integers of 32; a bit is set if tokens with it weigh more than those without.

    Weights are term frequencies, times idf (term, idf) where given; terms it lacks weigh nothing. One aggregate of 64 sums.
    """
    words = records.select("record_id", F.explode_outer(tokens(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    tf = words.groupBy("record_id", "term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if idf is not None:
        tf = tf.join(idf, "term").select("record_id", "term", (F.col("w") * F.col("idf")).alias("w"))
    d = F.md5("term")
    hashed = tf.select("record_id", "w", _hex(d, 1, 8).alias("hi"), _hex(d, 9, 8).alias("lo"))
    bit = lambda half, i: F.sum(F.when(F.shiftright(half, i).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w")))
    sums = hashed.groupBy("record_id").agg(*[bit(half, i).alias(f"{half}{i}") for half in ("hi", "lo") for i in range(32)])
    packed = lambda half: sum((F.when(F.round(F.col(f"{half}{i}"), 6) > 0, 1 << i).otherwise(0).cast("long") for i in range(32)), F.lit(0).cast("long"))
    return sums.select("record_id", packed("hi").alias("hi"), packed("lo").alias("lo"))


def simhash_pairs(hashed: DataFrame, most: int = 3) -> DataFrame:
    """a, b, distance of fingerprints within `most` bits: of most + 1 blocks one must be equal, so pairs meet on equal blocks only. simhash_classes() tells for whom a and b stand."""
    blocks, width = most + 1, 64 // (most + 1)
    whole = F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(whole, i * width).bitwiseAND(F.lit((1 << (width if i < blocks - 1 else 64 - width * (blocks - 1))) - 1 if width < 63 else -1)).alias("key")) for i in range(blocks)])
    first = hashed.groupBy("hi", "lo").agg(F.min("record_id").alias("record_id"))
    rows = first.select("record_id", "hi", "lo", F.inline(keys))
    side = lambda x: rows.select("block", "key", F.col("record_id").alias(x), F.col("hi").alias(f"hi_{x}"), F.col("lo").alias(f"lo_{x}"))
    distance = F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b"))) + F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b")))
    pairs = side("a").join(side("b"), ["block", "key"]).filter("a < b").select("a", "b", distance.alias("distance"))
    return pairs.filter(F.col("distance") <= most).distinct()


def exact_groups(records: DataFrame) -> DataFrame:
    """fingerprint, n, first_id of texts that occur more than once."""
    groups = records.groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))
    return groups.filter("n > 1")


def keep_first(records: DataFrame) -> DataFrame:
    """One record of each text, that with the smallest id; null texts count as one text. The least id combines before the shuffle, so that no group of
    copies meets in a task."""
    rest = [c for c in records.columns if c not in ("record_id", "text")]
    best = records.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("record_id", *rest, "text")).alias("row"))
    return best.select("row.*").select(*records.columns)


def top_tokens(weights: DataFrame, n: int = 32) -> DataFrame:
    """record_id, term, weight, nth: the n terms of each record that weigh most, positive or negative; ties by term. weights: (record_id, term, weight)."""
    first = Window.partitionBy("record_id").orderBy(F.desc(F.round(F.abs("weight"), 9)), "term")
    return weights.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n)
