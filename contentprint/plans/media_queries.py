"""Queries on images and clips. The tables hold neither, so each row of a table gets a picture or clip that its id determines."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import images
from ..operators import media
from ..scratch import cut, tidy
from ..session import bound_batches
from ..sources import tables as T
from .queries import query, rounded


def picture(i: int) -> bytes:
    y, x = np.mgrid[0:64, 0:64]
    rgb = np.stack([(x * (1 + i % 3)) % 256, (y + 5 * (i // 2 % 50)) % 256, np.full_like(x, 128)], axis=2)
    return images.encode_png(rgb)


def clip(i: int) -> bytes:
    """Two seconds of a chirp; odd ids have that of the even id before them, a quarter of a second later."""
    return _chirp(i // 2 % 40, i % 2)


@functools.lru_cache(80)
def _chirp(pitch: int, late: int) -> bytes:
    t = np.arange(16000) / 8000 - (0.256 if late else 0)
    base = 300 + 37 * pitch
    x = sum(0.3 * np.sin(2 * np.pi * (base * k * t + 150 * k * t * t)) * (np.sin(2 * np.pi * (k + 2) * t) > 0) for k in (1, 2, 3))
    return np.where(t >= 0, x, 0).astype("<f4").tobytes()


def _made(spark, d, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, media.CLIPS):  # an id is a few bytes, what is made of it 64 KB: few at a time
                ids = batch["page_id"].slice(i, media.CLIPS)
                yield pa.record_batch({"record_id": ids, "content": pa.array([None if x is None else make(x) for x in ids.to_pylist()], pa.binary())})

    bound_batches(spark)
    # ids are few bytes and the work on each is much: they are dealt to all cores, whatever the table's files
    ids = T.read(spark, d, "pages").select("page_id").repartition(spark.sparkContext.defaultParallelism, "page_id")
    return ids.mapInArrow(run, "record_id long, content binary")


@query("image_multihash")
def _(spark, d):
    return media.image_fingerprint(_made(spark, d, picture)).select("record_id", F.length("fingerprint").alias("n_bytes"), F.hex(F.substring("fingerprint", 65, 8)).alias("ahash"), "status")


@query("image_phash")
def _(spark, d):
    return media.image_fingerprint(_made(spark, d, picture), "phash").select("record_id", F.length("fingerprint").alias("n_bytes"), F.hex(F.substring("fingerprint", 33, 8)).alias("phash"))


@query("image_inspect")
def _(spark, d):
    return media.image_inspect(_made(spark, d, picture)).select("record_id", "width", "height", "ahash_mean")


@query("image_compare")
def _(spark, d):
    own = media.image_fingerprint(_made(spark, d, picture)).select("record_id", "fingerprint")
    pairs = own.withColumnRenamed("fingerprint", "fa").join(own.select((F.col("record_id") - 1).alias("record_id"), F.col("fingerprint").alias("fb")), "record_id")
    return rounded(media.image_compare(pairs).select("record_id", "likeness"), "likeness")


@query("audio_wang_matches")
def _(spark, d):
    return _wang_matches(spark, d)


@tidy
def _wang_matches(spark, d):
    found = cut(media.landmark_sets(_made(spark, d, clip)))
    return media.landmark_set_matches(found.filter("record_id % 100 = 0"), found, k=10, least=5)


@query("audio_panako")
def _(spark, d):
    found = media.landmark_sets(_made(spark, d, clip), "panako").filter(F.size("hashes") > 0)
    return found.groupBy("record_id").agg(F.sum(F.size("hashes")).alias("n_hashes"))


@query("audio_haitsma_compare")
def _(spark, d):
    own = media.haitsma(_made(spark, d, clip), 8000).select("record_id", "fingerprint")
    pairs = own.withColumnRenamed("fingerprint", "fa").join(own.select((F.col("record_id") - 1).alias("record_id"), F.col("fingerprint").alias("fb")), "record_id")
    return rounded(media.haitsma_compare(pairs).select("record_id", "bit_error_rate"), "bit_error_rate")


@query("audio_inspect")
def _(spark, d):
    return media.audio_inspect(_made(spark, d, clip)).select("record_id", "n_samples", "frames", "n_peaks", "n_pairs", "n_hashes", F.size("envelope").alias("n_envelope"))
