"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of a batch of rows on its way to a Python worker, in sessions that don't set the bound themselves: rows can be very long.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("contentprint").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
