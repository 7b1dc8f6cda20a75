"""Images and clips as columns of bytes, and their matching."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadInputError
from ..functions import audio, images
from ..functions.documents import pooled, spectrum_png
from ..scratch import cut
from ..session import bound_batches
from .kernels import EmbeddingProvider, embed


def _or_null(f):
    def one(x):
        try:
            return None if x is None else f(x)
        except BadInputError:
            return None

    return one


def image_fingerprint(records: DataFrame, algorithm: str = "multihash", guards: images.Guards = images.Guards()) -> DataFrame:
    """records (content) with fingerprint, null and status 400 for what can't be decoded."""
    f = _or_null((lambda d: images.bundle(d, guards)) if algorithm == "multihash" else (lambda d: images.single(d, algorithm, guards)))

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: f(None if d is None else bytes(d)))

    out = records.withColumn("fingerprint", run("content"))
    return out.withColumn("status", F.when(F.col("fingerprint").isNull(), 400).otherwise(201))


def image_inspect(records: DataFrame) -> DataFrame:
    f = _or_null(images.inspect)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(x) or {} for x in batch["content"].to_pylist()]
            kinds = {"width": pa.int32(), "height": pa.int32(), "grey32": pa.binary(), "grey8": pa.binary(), "ahash_mean": pa.int32()}
            yield pa.record_batch({"record_id": batch["record_id"], **{k: pa.array([m.get(k) for m in made], t) for k, t in kinds.items()}})

    return records.select("record_id", "content").mapInArrow(run, "record_id long, width int, height int, grey32 binary, grey8 binary, ahash_mean int")


def image_compare(pairs: DataFrame) -> DataFrame:
    """pairs (fa, fb: bundles) with likeness."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else images.compare(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("likeness", run("fa", "fb"))


#: Clips whose results leave a worker together.
CLIPS = 16


def landmark_sets(clips: DataFrame, algorithm: str = "wang") -> DataFrame:
    """record_id, marks (arrays hash, t) and their digest of clips (record_id, content: PCM at the algorithm's rate), a row a clip.
    Clips that can't be read have no marks. Clips of the same marks have the same digest."""
    bound_batches(clips.sparkSession)
    make = audio.wang if algorithm == "wang" else audio.panako
    f = _or_null(lambda d: np.array([x[:2] for x in make(audio.pcm(d))], np.int64).reshape(-1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CLIPS):
                part = batch.slice(i, CLIPS)
                own = [np.empty((0, 2), np.int64) if m is None else m for m in (f(x.as_py()) for x in part["content"])]
                ends, all_ = np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate(own)
                digests = [hashlib.sha256(m[np.lexsort(m.T)].tobytes()).digest() for m in own]
                yield pa.record_batch({
                    "record_id": part["record_id"], "digest": pa.array(digests, pa.binary()),
                    "hashes": pa.ListArray.from_arrays(ends, pa.array(all_[:, 0])), "times": pa.ListArray.from_arrays(ends, pa.array(all_[:, 1].astype(np.int32))),
                })

    return clips.select("record_id", "content").mapInArrow(run, "record_id long, digest binary, hashes array<long>, times array<int>")


def exploded(sets: DataFrame) -> DataFrame:
    """record_id, hash, t of landmark_sets."""
    return sets.select("record_id", F.explode(F.arrays_zip("hashes", "times")).alias("m")).select("record_id", F.col("m.hashes").alias("hash"), F.col("m.times").alias("t"))


def landmarks(clips: DataFrame, algorithm: str = "wang") -> DataFrame:
    """record_id, hash, t of clips (record_id, content: PCM at the algorithm's rate). Clips that can't be read have none."""
    return exploded(landmark_sets(clips, algorithm))


def landmark_matches(queries: DataFrame, index: DataFrame, least: int = 1, k: int | None = None, salts: int = 16) -> DataFrame:
    """qid, record_id, votes, offset: the most frequent difference in time among the hashes that a query shares with a record; pairs of fewer
    votes than `least` go, and with k only each query's k best stay.

    Both sides are (record_id, hash, t), written once by the caller. A hash that very many records share is dealt to `salts` tasks by record;
    votes are counted in each task before they meet.
    """
    q = queries.select(F.col("record_id").alias("qid"), "hash", F.col("t").alias("tq"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    votes = q.join(index.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")), ["hash", "salt"])
    votes = votes.groupBy("qid", "record_id", (F.col("t") - F.col("tq")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("best")
    found = votes.groupBy("qid", "record_id").agg(best).select("qid", "record_id", F.col("best.votes").alias("votes"), (-F.col("best.back")).alias("offset"))
    found = found.filter(F.col("votes") >= least)
    if k is None:
        return found
    first = Window.partitionBy("qid").orderBy(F.desc("votes"), "record_id")
    return found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).drop("r")


def landmark_set_matches(queries: DataFrame, index: DataFrame, k: int, least: int = 1, salts: int = 16) -> DataFrame:
    """What landmark_matches gives with k, of landmark_sets that the caller has written once, a row a record. Records of the same marks have the
    same votes: one of each stands for all on both sides, and its k smallest ids take their places in the rankings.

    The k best records of a query lie in its k best classes by votes and smallest id, as each class before another has at least one record that
    comes before all of the other's.
    """

    def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = sets.filter(F.size("hashes") > 0)
        first = cut(own.groupBy("digest").agg(F.min("record_id").alias("record_id")))  # its size is known to the planner then
        return own, own.join(first.select("record_id"), "record_id", "left_semi")

    (asked, asking), (own, standing) = classes(queries), classes(index)
    found = cut(landmark_matches(exploded(asking), exploded(standing), least, k, salts))
    of_class = own.select("digest", F.col("record_id").alias("member"))
    place = Window.partitionBy("digest").orderBy("member")
    members = of_class.withColumn("i", F.row_number().over(place)).filter(F.col("i") <= k).drop("i")
    members = cut(members.withColumn("record_id", F.min("member").over(Window.partitionBy("digest"))).select("record_id", "member"))
    first = Window.partitionBy("qid").orderBy(F.desc("votes"), "record_id")
    best = found.join(members, "record_id").select("qid", F.col("member").alias("record_id"), "votes", "offset")
    best = best.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).drop("r")
    digests = asking.select(F.col("record_id").alias("qid"), "digest")
    best = cut(best.join(digests, "qid").drop("qid"))
    return asked.select(F.col("record_id").alias("qid"), "digest").join(best, "digest").select("qid", "record_id", "votes", "offset")


def haitsma(clips: DataFrame, rate: int) -> DataFrame:
    f = _or_null(lambda d: audio.haitsma(audio.pcm(d), rate).astype("<u4").tobytes())

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: f(None if d is None else bytes(d)))

    return clips.withColumn("fingerprint", run("content"))


def haitsma_compare(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([audio.bit_error_rate(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("bit_error_rate", run("fa", "fb"))


INSPECTED = "n_samples long, seconds double, envelope array<double>, frames int, peaks array<struct<t_ms:double,hz:double>>, n_peaks int, pairs array<struct<t_ms:double,hz:double,to_ms:double,to_hz:double>>, n_pairs int, n_hashes int, spectrum binary"


def audio_inspect(clips: DataFrame, rate: int = 8000) -> DataFrame:
    """What an inspection page shows of (record_id, content): the envelope, at most 256 peaks and pairs in milliseconds and hertz beside how
    many there are, and a PNG of the spectrum. Clips that can't be read have nulls."""

    def one(data: bytes) -> dict:
        samples = audio.pcm(data)
        made = audio.inspect(samples, rate)
        whole = pooled(made["spectrum"].T[::-1], 128, 512)[::-1].T  # as few values as the picture has
        place = lambda t, f: (audio.frame_ms(t, rate), audio.bin_hz(f, rate))
        made["peaks"] = [dict(zip(("t_ms", "hz"), place(t, f), strict=True)) for t, f in made["peaks"]]
        made["pairs"] = [dict(zip(("t_ms", "hz", "to_ms", "to_hz"), place(t, f) + place(u, g), strict=True)) for t, f, u, g in made["pairs"]]
        return made | {"spectrum": spectrum_png(audio.decibel(whole))}

    f = _or_null(one)
    bound_batches(clips.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = [("t_ms", pa.float64()), ("hz", pa.float64())]
        line = [*point, ("to_ms", pa.float64()), ("to_hz", pa.float64())]
        kinds = {"n_samples": pa.int64(), "seconds": pa.float64(), "envelope": pa.list_(pa.float64()), "frames": pa.int32(), "peaks": pa.list_(pa.struct(point)), "n_peaks": pa.int32(), "pairs": pa.list_(pa.struct(line)), "n_pairs": pa.int32(), "n_hashes": pa.int32(), "spectrum": pa.binary()}
        for batch in batches:
            for i in range(0, batch.num_rows, CLIPS):  # clips and pictures are large: few at a time
                part = batch.slice(i, CLIPS)
                made = [f(x.as_py()) or {} for x in part["content"]]
                yield pa.record_batch({"record_id": part["record_id"], **{k: pa.array([m.get(k) for m in made], t) for k, t in kinds.items()}})

    return clips.select("record_id", "content").mapInArrow(run, f"record_id long, {INSPECTED}")


def semantic(records: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Pictures (content) with embedding and model_id, by a provider that takes their bytes; null contents are empty bytes to it."""
    return embed(records, provider, "content")


def neural(clips: DataFrame, provider: EmbeddingProvider, rate: int, fmax: float | None = None) -> DataFrame:
    """Clips (content) with embedding, model_id and fmax, half of the rate if not given. The rate must be that of the algorithm."""
    if rate != audio.RATES["neural"]:
        raise BadInputError(f"neural takes {audio.RATES['neural']} Hz, not {rate}")
    fmax = rate / 2 if fmax is None else fmax
    if not 0 < fmax <= rate / 2:
        raise BadInputError(f"fmax {fmax}")
    return embed(clips, provider, "content").withColumn("fmax", F.lit(float(fmax)))


def watermark(clips: DataFrame, detect: Callable[[np.ndarray], tuple[float, int]], threshold: float = 0.5) -> DataFrame:
    """record_id, score, detected, payload (four little-endian bytes, null unless detected) by a detector that gives a score and a message
    for samples at 16 kHz. Clips that can't be read have no score and aren't detected."""
    f = _or_null(lambda d: detect(audio.pcm(d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(x) for x in batch["content"].to_pylist()]
            hit = [m is not None and m[0] >= threshold for m in made]
            yield pa.record_batch({
                "record_id": batch["record_id"], "score": pa.array([None if m is None else float(m[0]) for m in made], pa.float64()),
                "detected": pa.array(hit, pa.bool_()), "payload": pa.array([int(m[1]).to_bytes(4, "little") if h else None for m, h in zip(made, hit, strict=True)], pa.binary()),
            })

    return clips.select("record_id", "content").mapInArrow(run, "record_id long, score double, detected boolean, payload binary")
