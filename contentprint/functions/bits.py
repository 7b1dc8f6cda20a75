"""Expressions on bytes and bits, over hexadecimal strings and 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nibbles(hexadecimal: Column) -> Column:
    """The characters of a hexadecimal string as integers."""
    return F.transform(F.filter(F.split(hexadecimal, ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def hamming_hex(a: Column, b: Column) -> Column:
    """Different bits over the shorter of two hexadecimal strings."""
    n = F.least(F.length(a), F.length(b))
    cut = lambda x: nibbles(F.substring(x, F.lit(1), n))
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda p, q: p + q)


def bit_match(a: Column, b: Column) -> Column:
    """The percentage of equal bits of two hexadecimal strings of one length."""
    return 100.0 * (1 - hamming_hex(a, b) / (4 * F.least(F.length(a), F.length(b))))


def byte_frequencies(df: DataFrame, key: str, hexadecimal: str, high_nibble: bool = False) -> DataFrame:
    """key, value, n: how often each byte value (or each value of the high four bits) occurs in a hexadecimal string."""
    places = F.sequence(F.lit(1), F.length(hexadecimal) - 1, F.lit(2))
    each = df.filter(F.length(hexadecimal) > 1).select(key, hexadecimal, F.explode(places).alias("at"))
    value = F.conv(F.substring(hexadecimal, F.col("at"), F.lit(1 if high_nibble else 2)), 16, 10).cast("int")
    return each.groupBy(key, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def byte_entropy(df: DataFrame, key: str, hexadecimal: str) -> DataFrame:
    """key, entropy: Shannon entropy in bits a byte. From sums of n and n log n, so that every step combines before the shuffle."""
    n = F.col("n").cast("double")
    sums = byte_frequencies(df, key, hexadecimal).groupBy(key).agg(F.sum(n).alias("total"), F.sum(n * F.log2(n)).alias("logs"))
    return sums.select(key, (F.log2("total") - F.col("logs") / F.col("total")).alias("entropy"))


def landmark(hash_: Column) -> Column:
    """The fields of a 32-bit landmark: two frequencies of nine bits and a time difference of fourteen."""
    return F.struct(
        F.shiftrightunsigned(hash_, 23).bitwiseAND(F.lit(511)).alias("f_a"),
        F.shiftrightunsigned(hash_, 14).bitwiseAND(F.lit(511)).alias("f_b"),
        hash_.bitwiseAND(F.lit((1 << 14) - 1)).alias("dt"),
    )


def unpacked(hexadecimal: Column) -> Column:
    """The bits of a hexadecimal string as integers, the highest of each byte first."""
    four = lambda v: F.array(*[F.shiftrightunsigned(v, i).bitwiseAND(F.lit(1)) for i in (3, 2, 1, 0)])
    return F.flatten(F.transform(nibbles(hexadecimal), four))


# The offset and the factor of the 32-bit FNV-1a hash, and those of the linear congruence that stretches it.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
STEP_FACTOR, STEP_ADDEND = 1664525, 1013904223
_WORD = (1 << 32) - 1


def fnv1a(text: Column) -> Column:
    """The FNV-1a hash of a text's code points (UTF-16 units of texts in the basic plane), for demonstrations only."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(_WORD).cast("long")))


def stretched(seed: Column, n: int = 32) -> Column:
    """n bytes in hexadecimal from a 32-bit seed: the low bytes of a linear congruence."""
    step = lambda s: (s * F.lit(STEP_FACTOR).cast("long") + F.lit(STEP_ADDEND).cast("long")).bitwiseAND(F.lit(_WORD).cast("long"))
    start = F.struct(seed.cast("long").alias("s"), F.lit("").alias("out"))

    def more(held: Column, _: Column) -> Column:
        s = step(held["s"])
        return F.struct(s.alias("s"), F.concat(held["out"], F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(255)))), 2, "0")).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, more, lambda held: held["out"])
