"""The record store: upsert, delete, describe, versioned snapshots and tenant guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadInputError, ForbiddenError, IncompatibleError, RecordNotFoundError

SCHEMA = T.StructType([
    T.StructField("tenant_id", T.LongType()),
    T.StructField("record_id", T.LongType()),
    T.StructField("modality", T.StringType()),
    T.StructField("format_version", T.LongType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("config_hash", T.DecimalType(20, 0)),
    T.StructField("fingerprint", T.BinaryType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("model_id", T.StringType()),
    T.StructField("metadata", T.BinaryType()),
    T.StructField("text", T.StringType()),
])
KEY = ["tenant_id", "record_id"]


def latest(batch: DataFrame, order: Column) -> DataFrame:
    """The last row of each key by `order`."""
    last = Window.partitionBy(*KEY).orderBy(order.desc())
    return batch.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")


def upsert(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """Whole rows are replaced: a null embedding or text in the new row clears the old one."""
    new = latest(new, order) if order is not None else new
    new = new.select(*old.columns)
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that aren't there are ignored."""
    return old.join(keys.select(*KEY), KEY, "left_anti")


def describe(records: DataFrame) -> DataFrame:
    """Sizes instead of blobs."""
    return records.select(
        *KEY, "modality", "algorithm", "format_version",
        F.octet_length("fingerprint").alias("fingerprint_bytes"), F.col("embedding").isNotNull().alias("has_embedding"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("embedding_dim"), F.coalesce(F.octet_length("metadata"), F.lit(0)).alias("metadata_bytes"), F.col("text").isNotNull().alias("has_text"),
    )


def config_hash(*parts: Column | str) -> Column:
    """A number for a configuration: the first 60 bits of the MD5 of its parts (canonical form, tokenizer, algorithm). A null part is an empty one."""
    whole = F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("decimal(20,0)")


def comparable(a: str = "a", b: str = "b") -> Column:
    """Whether the structs a and b have one algorithm, format version and configuration; nulls are equal to each other."""
    same = [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in ("algorithm", "format_version", "config_hash")]
    return same[0] & same[1] & same[2]


def compared(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """pairs (a, b: structs of records) with status 200, or 409 where they can't be compared; strict: one such pair is an error."""
    out = pairs.withColumn("status", F.when(comparable(), 200).otherwise(409))
    if strict and out.filter("status = 409").limit(1).count():
        raise IncompatibleError("records of different algorithms, format versions or configurations")
    return out


def page(records: DataFrame, modality: str | None = None, label: str | None = None, n: int = 25) -> DataFrame:
    """The n newest records of a modality whose label holds a text, whatever its case."""
    out = records if modality is None else records.filter(F.lower("modality") == modality.lower())
    out = out if not label else out.filter(F.contains(F.lower("label"), F.lit(label.lower())))
    return out.orderBy(F.desc("record_id")).limit(n)


def get(records: DataFrame, tenant_id: int, record_id: int):
    found = describe(records.filter((F.col("tenant_id") == tenant_id) & (F.col("record_id") == record_id))).limit(1).collect()
    if not found:
        raise RecordNotFoundError(f"no record {record_id} of tenant {tenant_id}")
    return found[0]


def tenant_guard(key_tenant: int, path_tenant: int) -> None:
    """Tenant 0 is a service key for all tenants."""
    if key_tenant not in (0, path_tenant):
        raise ForbiddenError(f"the key of tenant {key_tenant} can't reach tenant {path_tenant}")


def guarded(requests: DataFrame) -> DataFrame:
    """requests with status 403 where key_tenant may not reach path_tenant, else 200."""
    return requests.withColumn("status", F.when((F.col("key_tenant") != 0) & (F.col("key_tenant") != F.col("path_tenant")), 403).otherwise(200))


def ingest_response(records: DataFrame, return_embedding: bool = False) -> DataFrame:
    out = records.select(*KEY, "algorithm", F.lower(F.hex("fingerprint")).alias("fingerprint_hex"), F.octet_length("fingerprint").alias("fingerprint_bytes"))
    return out.join(records.select(*KEY, "embedding"), KEY) if return_embedding else out


def bulk_in(spark: SparkSession, path: str, index_text: bool = False) -> DataFrame:
    """Records from JSON lines whose bytes are arrays of integers. Without index_text they have no text, so keyword search doesn't find them."""
    wire = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType()) if f.dataType == T.BinaryType() else f.dataType) for f in SCHEMA])
    df = spark.read.schema(wire).json(path)
    raw = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    df = df.withColumns({c: F.when(F.col(c).isNotNull(), raw(F.col(c))) for c in ("fingerprint", "metadata")})
    return (df if index_text else df.withColumn("text", F.lit(None).cast("string"))).select(*[f.name for f in SCHEMA])


class Store:
    """Versioned Parquet snapshots, partitioned by tenant. A version is complete once its manifest file is there; readers pin one version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._p = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[len("_v") :]) for n in names if n.startswith("_v"))

    def read(self, version: int | None = None) -> DataFrame:
        held = self.versions()
        if version is None and not held:
            return self.spark.createDataFrame([], SCHEMA)
        version = held[-1] if version is None else version
        if version not in held:
            raise RecordNotFoundError(f"no version {version}")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{version}").select(*[f.name for f in SCHEMA])

    def commit(self, records: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        records.select(*[f.name for f in SCHEMA]).write.mode("overwrite").partitionBy("tenant_id").parquet(f"{self.path}/v{version}")
        self._fs.create(self._p(f"{self.path}/_v{version}"), True).close()
        return version

    def upsert(self, batch: DataFrame, order: Column | None = None) -> int:
        if set(KEY) - set(batch.columns):
            raise BadInputError("a batch needs tenant_id and record_id")
        return self.commit(upsert(self.read(), batch, order))

    def bulk(self, path: str, index_text: bool = False) -> dict:
        """Upserts JSON lines; says how many records they hold."""
        batch = bulk_in(self.spark, path, index_text)
        return {"upserted": batch.select(*KEY).distinct().count(), "version": self.upsert(batch, F.xxhash64(*[c for c in batch.columns]))}

    def delete(self, keys: DataFrame) -> int:
        return self.commit(delete(self.read(), keys))

    def healthy(self) -> bool:
        """Whether the store answers: its newest version, if it has any, can be read."""
        return not self.versions() or self.read().limit(1).count() >= 0

    def prune(self, keep: int = 24) -> list[int]:
        gone = self.versions()[: -keep if keep else None]
        for v in gone:
            self._fs.delete(self._p(f"{self.path}/_v{v}"), False)
            self._fs.delete(self._p(f"{self.path}/v{v}"), True)
        return gone

    def restore(self, version: int) -> int:
        return self.commit(self.read(version))


def new_store_path(base: str) -> str:
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"
