"""Readers of raw inputs, and sinks for usage and exports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import images

EVENT = "tenant_id long, key_id string, op string, modality string, algorithm string, bytes_in long, units long, elapsed_ms long, status int, ts long"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, status of whole files: 400 and a null text for what isn't UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(ok, F.col("content").cast("string")).alias("text"), F.when(ok, 200).otherwise(400).alias("status"))


def pcm_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, status of files of 32-bit floats: 400 if the bytes aren't whole floats."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.withColumn("status", F.when(F.length("content") % 4 == 0, 200).otherwise(400))


def image_files(spark: SparkSession, path: str, max_bytes: int = 16 << 20) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return raw.withColumn("status", F.when(F.col("length") <= max_bytes, 200).otherwise(400)).drop("length")


def ndjson_chunks(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, chunk, status: each line a JSON string, blank lines passed over, anything else 400. A file is one request's body and is read
    whole, so that its lines keep their order; line_no counts from 0 and includes blank lines."""
    bodies = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    lines = bodies.withColumn("line", F.regexp_replace("line", r"\r$", "")).filter(F.trim("line") != "")
    ok = F.col("line").rlike(r'^\s*"(?:[^"\\]|\\.)*"\s*$')
    return lines.select("path", "line_no", F.when(ok, F.get_json_object(F.concat(F.lit('{"c":'), "line", F.lit("}")), "$.c")).alias("chunk"), F.when(ok, 200).otherwise(400).alias("status"))


def audio_chunks(spark: SparkSession, path: str) -> DataFrame:
    """session, chunk_no, content, status of files <session>/<number> under path (any extension): the parts of an upload. 400 for bytes that
    aren't whole floats."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.split("path", "/")
    named = raw.select(F.element_at(at, -2).alias("session"), F.regexp_extract(F.element_at(at, -1), r"^(\d+)", 1).cast("int").alias("chunk_no"), "content")
    return named.filter("chunk_no IS NOT NULL").withColumn("status", F.when(F.length("content") % 4 == 0, 200).otherwise(400))


def decoded_images(spark: SparkSession, path: str, min_dim: int = 8, max_dim: int = 8192) -> DataFrame:
    """path, content (a PNG of the pixels), width, height, status of picture files that the JVM decodes (JPEG, PNG, GIF, BMP): 400 and no content
    for what it can't, and for sizes out of bounds."""
    raw = spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    ok = (F.col("channels").isin(1, 3, 4)) & (F.least("width", "height") >= min_dim) & (F.greatest("width", "height") <= max_dim)

    @F.pandas_udf("binary")
    def png(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else images.encode_png(_rgb(bytes(d), h, w, c)) for w, h, c, d in zip(width, height, channels, data, strict=True)], dtype=object)

    good = F.when(ok, F.col("data"))
    return raw.select(F.col("origin").alias("path"), png("width", "height", "channels", good).alias("content"), "width", "height", F.when(ok, 200).otherwise(400).alias("status"))


def _rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of blue, green and red bytes as red, green and blue."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path).withColumn("ts", F.timestamp_millis("ts"))


def append_usage(events: DataFrame, path: str) -> None:
    """NDJSON with times in unix milliseconds."""
    events.withColumn("ts", F.unix_millis("ts")).write.mode("append").json(path)


def webhook(poster: Callable[[str], None], batch: int = 32, attempts: int = 5, first_s: float = 0.1, most_s: float = 5.0, sleep: Callable[[float], None] = time.sleep, dropped: str | None = None):
    """A sink for foreachBatch: JSON lists of at most `batch` events, retried with doubling pauses, then dropped. Dropped events are counted in the
    sink's `lost`, by batch, and, if a path is given as `dropped`, written there as JSON lines."""

    def part(rows: Iterator[Row]) -> Iterator[Row]:
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict())
            if len(held) == batch:
                yield from post(held)
                held = []
        if held:
            yield from post(held)

    def post(events: list[dict]) -> Iterator[Row]:
        pause = first_s
        body = json.dumps(events, default=str)
        for n in range(attempts):
            try:
                poster(body)
                return
            except OSError:
                if n < attempts - 1:
                    sleep(pause)
                    pause = min(most_s, 2 * pause)
        yield from (Row(event=json.dumps(e, default=str)) for e in events)

    def sink(df: DataFrame, epoch: int) -> None:
        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (Row(**r) for pdf in batches for r in pdf.astype(object).to_dict("records"))
            yield pd.DataFrame({"event": [r.event for r in part(rows)]}, dtype=object)

        gone = df.mapInPandas(send, "event string")
        if dropped is None:
            sink.lost[epoch] = gone.count()
        else:
            gone.write.mode("append").text(dropped)  # posted once: what is counted is read from there
            sink.lost[epoch] = 0

    sink.lost = {}
    return sink


def export_manifest(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)
