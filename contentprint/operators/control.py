"""Keys, tenants and rate limits."""

from __future__ import annotations

import hmac
import json
import math
import time
import tomllib
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import BadInputError

KEYS = "token string, tenant_id long, key_id string, scopes array<string>, rate_class string"
PER_MINUTE, PER_DAY = 600, 50_000
RPS, BURST = 100.0, 200.0


def keys_from_toml(spark: SparkSession, text: str) -> DataFrame:
    """The [[key]] tables of a key file."""
    return _key_table(spark, tomllib.loads(text).get("key", []))


def _key_table(spark: SparkSession, keys: list[dict]) -> DataFrame:
    rows = [(k.get("token"), k.get("tenant_id"), k.get("key_id"), k.get("scopes", []), k.get("rate_class")) for k in keys]
    if any(not r[0] or r[1] is None or not r[2] for r in rows):
        raise BadInputError("a key needs token, tenant_id and key_id")
    return spark.createDataFrame(rows, KEYS)


class StaticKeys:
    """Lookup by comparison in constant time, for tables of a size that is held by one process."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def lookup(self, presented: str) -> dict | None:
        found = None
        for row in self.rows:
            if hmac.compare_digest(row["token"].encode(), presented.encode()):
                found = row
        return found


def authenticate(requests: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """requests (id, token) with the key's and owner's columns and status 200, or 401 for no such active key. Keys are found by the hash of the token."""
    active = keys.filter(F.col("revoked_at").isNull()).join(users, "user_id")
    active = active.select("key_hash", "key_id", "user_id", "tenant_id", F.coalesce("per_minute", F.lit(PER_MINUTE)).alias("per_minute"), F.coalesce("per_day", F.lit(PER_DAY)).alias("per_day"))
    out = requests.withColumn("key_hash", F.sha2("token", 256)).join(active, "key_hash", "left")
    return out.withColumn("status", F.when(F.col("key_id").isNull(), 401).otherwise(200)).drop("key_hash", "token")


def revoke(keys: DataFrame, key_id, user_id, at: int) -> DataFrame:
    """Only the owner's own and not yet revoked key changes; revoked() says whether one does."""
    own = (F.col("key_id") == key_id) & (F.col("user_id") == user_id) & F.col("revoked_at").isNull()
    return keys.withColumn("revoked_at", F.when(own, F.lit(at)).otherwise(F.col("revoked_at")))


def revoked(keys: DataFrame, key_id, user_id) -> bool:
    """Whether revoke() changes a row."""
    return keys.filter((F.col("key_id") == key_id) & (F.col("user_id") == user_id) & F.col("revoked_at").isNull()).limit(1).count() > 0


def active_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("revoked_at").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_keys"))


def next_tenant(users: DataFrame) -> DataFrame:
    return users.agg((F.coalesce(F.max("tenant_id"), F.lit(0)) + 1).alias("next_tenant_id"))


def token_bucket(requests: DataFrame, rps: float = RPS, burst: float = BURST) -> DataFrame:
    """requests (key, id, ts_ms, cost) with allowed, remaining, retry_after_ms. The bucket's level depends on every earlier decision, so a key is
    walked in order; Arrow batches of one key arrive in order of time, and only the level is held."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, level, last = None, burst, None
        for pdf in parts:
            out = []
            for key, ts, cost in zip(pdf["key"], pdf["ts_ms"], pdf["cost"], strict=True):
                if key != held:  # sorted: no earlier key comes again
                    held, level, last = key, burst, None
                level = burst if last is None else min(burst, level + max(0, ts - last) / 1000 * rps)
                last = ts if last is None else max(last, ts)
                ok = cost <= burst and level >= cost
                level -= cost if ok else 0
                out.append((ok, int(level), 0 if ok else math.ceil((cost - level) / rps * 1000)))
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "allowed": [o[0] for o in out], "remaining": [o[1] for o in out], "retry_after_ms": [o[2] for o in out]})

    placed = requests.repartition("key").sortWithinPartitions("key", "ts_ms", "id")
    return placed.mapInPandas(walk, "key string, id long, allowed boolean, remaining long, retry_after_ms long")


def classify(requests: DataFrame) -> DataFrame:
    """requests (path, authed, allowed, ok) with op and status, in the order that a gateway checks: key, rate, handler."""
    op = F.when(F.col("path").rlike("^/v1/ingest/"), "ingest").when(F.col("path").rlike("^/v1/query"), "query").when(F.col("path").rlike("^/v1/records"), "records").otherwise("other")
    return requests.withColumn("op", op).withColumn("status", F.when(~F.col("authed"), 401).when(~F.col("allowed"), 429).when(~F.col("ok"), 500).otherwise(200))


TOKEN_PREFIX = "key_"


def gateway(requests: DataFrame, keys: DataFrame, users: DataFrame, prefix: str = TOKEN_PREFIX) -> DataFrame:
    """requests (id, token, ts seconds) through the whole chain, in the order of a gateway: a token must be there, begin with `prefix`, belong
    to an active key, and be within that key's minute and day. With key_id, user_id, tenant_id, status, message, minute_left and day_left.

    A request that its minute turns away doesn't count against the day. Requests of a window go by ts, then id.
    """
    c = F.col
    shaped = F.coalesce(F.trim("token").startswith(prefix), F.lit(False))
    known = authenticate(requests.select("id", "ts", "token", F.when(c("token").isNull() | (F.trim("token") == ""), "missing api key").when(~shaped, "invalid api key format").alias("message")), keys, users)
    known = known.withColumn("message", F.coalesce("message", F.when(c("key_id").isNull(), "invalid or revoked api key")))
    # requests without a key have no window: they stay out of the sort, where all of them would be one group
    refused = known.filter(c("message").isNotNull()).select("id", F.lit(None).cast("long").alias("key_id"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("tenant_id"), F.lit(401).alias("status"), "message", F.lit(None).cast("long").alias("minute_left"), F.lit(None).cast("long").alias("day_left"))
    order = ["ts", "id"]
    minute = Window.partitionBy("key_id", "minute").orderBy(*order)
    day = Window.partitionBy("key_id", "day").orderBy(*order)
    own = known.filter(c("message").isNull()).withColumns({"minute": F.floor(c("ts") / 60), "day": F.floor(c("ts") / 86400)})
    own = own.withColumn("in_minute", F.row_number().over(minute)).withColumn("passed", c("in_minute") <= c("per_minute"))
    own = own.withColumn("in_day", F.sum(c("passed").cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    late = c("passed") & (c("in_day") > c("per_day"))
    answered = own.select(
        "id", "key_id", "user_id", "tenant_id", F.when(~c("passed") | late, 429).otherwise(200).alias("status"),
        F.when(~c("passed"), "rate limit exceeded").when(late, "daily quota exceeded").alias("message"),
        F.greatest(c("per_minute") - c("in_minute"), F.lit(0)).cast("long").alias("minute_left"), F.greatest(c("per_day") - c("in_day"), F.lit(0)).cast("long").alias("day_left"),
    )
    return answered.unionByName(refused)


def size_guard(requests: DataFrame, column: str, most: int = 16 << 20) -> DataFrame:
    """requests with status 413 where the body has more than `most` bytes, else 200; no body is an empty one."""
    return requests.withColumn("status", F.when(F.octet_length(column) > most, 413).otherwise(200))


class CachedLookup:
    """A key lookup through a callable that answers for one token with a row or None. Both answers are kept for `ttl` seconds; at `most` held
    answers all go. For a driver or a worker: what it holds is bounded."""

    def __init__(self, ask: Callable[[str], dict | None], ttl: float = 60.0, most: int = 4096, clock: Callable[[], float] = time.monotonic):
        self.ask, self.ttl, self.most, self.clock, self.held = ask, ttl, most, clock, {}

    def lookup(self, presented: str) -> dict | None:
        now = self.clock()
        known = self.held.get(presented)
        if known and now - known[0] < self.ttl:
            return known[1]
        found = self.ask(presented)
        if len(self.held) >= self.most:
            self.held.clear()
        self.held[presented] = now, found
        return found


def keys_from_json(spark: SparkSession, text: str) -> DataFrame:
    """The objects of a JSON list as a key table."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise BadInputError("not JSON") from e
    if not isinstance(found, list) or not all(isinstance(k, dict) for k in found):
        raise BadInputError("keys are a list of objects")
    return _key_table(spark, found)


def key_source(settings: Mapping[str, str]) -> tuple[str, str]:
    """Which of the settings webhook, file and token holds: the first that is there and not blank, in this order."""
    for kind in ("webhook", "file", "token"):
        if settings.get(kind, "").strip():
            return kind, settings[kind].strip()
    raise BadInputError("no source of keys is set")


def cache_hits(gets: DataFrame, puts: DataFrame, ttl: int = 600) -> DataFrame:
    """gets (tenant_id, key, id, at) with put_at and hit: whether the latest put (tenant_id, key, at, live) up to then was a live one (not a
    removal) less than `ttl` seconds ago. Entries expire when they are asked for. A put comes before a get of the same second; of puts of one
    second a live one holds."""
    c = F.col
    puts = puts.groupBy("tenant_id", "key", "at").agg(F.max("live").alias("live"))
    both = puts.select("tenant_id", "key", F.lit(None).cast("long").alias("id"), "at", F.struct("at", "live").alias("put")).unionByName(
        gets.select("tenant_id", "key", "id", "at", F.lit(None).cast("struct<at:bigint,live:boolean>").alias("put")))
    before = Window.partitionBy("tenant_id", "key").orderBy("at", F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("put", ignorenulls=True).over(before)).filter("id IS NOT NULL")
    hit = F.coalesce(c("last.live") & (c("at") - c("last.at") < ttl), F.lit(False))
    return seen.select("tenant_id", "key", "id", "at", c("last.at").alias("put_at"), hit.alias("hit"))
