"""The driver's tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANTS = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select((F.col("doc_id") % TENANTS).alias("tenant_id"), F.col("doc_id").alias("record_id"), "text")


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") % TENANTS).alias("tenant_id"), F.col("vec_id").alias("record_id"), "embedding")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 10).alias("api_key_id"),
        F.when(kind == "click", "image").when(kind.isin("purchase", "signup"), "audio").otherwise("text").alias("modality"),
        F.octet_length("props").cast("long").alias("bytes_in"), F.when(kind == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").cast("long").alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), F.sha2(F.concat(F.lit("key_"), F.col("o_orderkey").cast("string")), 256).alias("key_hash"),
        F.when(F.col("o_orderstatus") == "F", 1).alias("revoked_at"), F.when(F.col("o_orderkey") % 2 == 0, 60).alias("per_minute"), F.lit(None).cast("int").alias("per_day"),
    )
