"""The algorithms and the bounds of what can be tuned in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import BadInputError

#: modality, algorithm, fixed bytes (0: grows with the input), least input (bytes or Hz), provider needed. Fixed values.
ALGORITHMS = [
    ("text", "minhash", 1032, 0, False), ("text", "lsh", 1032, 0, False), ("text", "simhash-tf", 8, 0, False), ("text", "simhash-idf", 8, 0, False), ("text", "tlsh", 70, 50, False),
    ("text", "semantic-local", 0, 0, True), ("text", "semantic-openai", 0, 0, True), ("text", "semantic-voyage", 0, 0, True), ("text", "semantic-cohere", 0, 0, True),
    ("image", "multi", 536, 0, False), ("image", "phash", 168, 0, False), ("image", "dhash", 168, 0, False), ("image", "ahash", 168, 0, False), ("image", "semantic", 0, 0, True),
    ("audio", "wang", 0, 8000, False), ("audio", "panako", 0, 8000, False), ("audio", "haitsma", 0, 5000, False), ("audio", "neural", 0, 16000, True), ("audio", "watermark", 0, 16000, True),
]
#: algorithm, name, least, most, step, default. Fixed values.
TUNABLES = [
    ("minhash", "k", 1, 16, 1, 5), ("lsh", "k", 1, 16, 1, 5),
    ("wang", "fan_out", 1, 32, 1, 10), ("wang", "target_zone_t", 1, 255, 1, 63), ("wang", "target_zone_f", 1, 255, 1, 64), ("wang", "peaks_per_sec", 1, 100, 1, 30), ("wang", "min_anchor_mag_db", -100, 0, 1, -50),
    ("panako", "fan_out", 1, 32, 1, 5), ("panako", "target_zone_t", 1, 255, 1, 96), ("panako", "target_zone_f", 1, 255, 1, 96), ("panako", "peaks_per_sec", 1, 100, 1, 30), ("panako", "min_anchor_mag_db", -100, 0, 1, -50),
    ("haitsma", "fmin", 50, 2000, 10, 300), ("haitsma", "fmax", 500, 2500, 10, 2000),
]


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALGORITHMS, "modality string, algorithm string, n_bytes int, least_input int, needs_provider boolean")


def tunables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, n, float(lo), float(hi), float(s), float(x)) for a, n, lo, hi, s, x in TUNABLES], "algorithm string, name string, least double, most double, step double, preset double")


def checked(algorithm: str, **options: float) -> dict[str, float]:
    """The options with defaults filled in; unknown names and values out of bounds are bad input."""
    known = {n: (lo, hi, x) for a, n, lo, hi, _, x in TUNABLES if a == algorithm}
    for name, value in options.items():
        if name not in known or not known[name][0] <= value <= known[name][1]:
            raise BadInputError(f"{algorithm}: {name}={value}")
    return {n: options.get(n, x) for n, (_, _, x) in known.items()}
