"""Usage analytics over events (id, user_id, api_key_id, modality, algorithm, bytes_in, status, latency_ms, created_at in unix seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODALITIES = ("text", "image", "audio")


def day(created_at: str = "created_at"):
    return F.to_date(F.timestamp_seconds(created_at))


def days(raw: str | None, default: int = 30, most: int = 365) -> int:
    """A number of days out of a request's parameter."""
    try:
        n = int(raw)
    except (TypeError, ValueError):
        return default
    return min(n, most) if n > 0 else default


def by_day(events: DataFrame, since: int) -> DataFrame:
    return events.filter(F.col("created_at") >= since).groupBy(day().alias("day"), "modality").agg(F.count(F.lit(1)).alias("n"))


def summary(events: DataFrame, since: int) -> DataFrame:
    """One row: total, one column for each modality, errors (status of 400 or more); zeros without events."""
    own = events.filter(F.col("created_at") >= since)
    return own.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES], F.count_if(F.col("status") >= 400).alias("errors"))


def pivot(events: DataFrame, since: int) -> DataFrame:
    """day, text, image, audio with zeros for days without a modality."""
    return by_day(events, since).groupBy("day").pivot("modality", list(MODALITIES)).agg(F.sum("n")).na.fill(0, list(MODALITIES))


def shares(events: DataFrame) -> DataFrame:
    """modality, n, share of all events. The totals are as many as there are modalities."""
    n = events.groupBy("modality").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def recent(events: DataFrame, limit: int = 25) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def page(events: DataFrame, before: int, modality: str | None = None, status: int | None = None, limit: int = 50) -> DataFrame:
    """Keyset paging: the newest ids below `before`."""
    own = events.filter(F.col("id") < before)
    own = own.filter(F.col("modality") == modality) if modality else own
    own = own.filter(F.col("status") == status) if status else own
    return own.orderBy(F.desc("id")).limit(limit)


def latency_histogram(events: DataFrame, edges: tuple[float, ...] = (5, 10, 25, 50, 100, 250, 500, 1000)) -> DataFrame:
    """modality, status, le (the bucket's upper edge, infinity as null), n, cumulative n."""
    bucket = F.lit(None).cast("double")
    for e in reversed(edges):
        bucket = F.when(F.col("latency_ms") <= e, F.lit(float(e))).otherwise(bucket)
    n = events.groupBy("modality", "status", bucket.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.partitionBy("modality", "status").orderBy(F.asc_nulls_last("le"))))


def fixed_window(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """requests (key, ts seconds, id) with slot, nth and allowed: the first `limit` of each window pass."""
    slot = F.floor(F.col("ts") / seconds)
    nth = F.row_number().over(Window.partitionBy("key", slot).orderBy("ts", "id"))
    return requests.withColumn("slot", slot).withColumn("nth", nth).withColumn("allowed", F.col("nth") <= limit)


def quota(requests: DataFrame, per_day: int) -> DataFrame:
    """key, day, used, left, over of the UTC day."""
    used = requests.groupBy("key", day("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("left", F.greatest(F.lit(per_day) - F.col("used"), F.lit(0))).withColumn("over", F.col("used") > per_day)


def status_rollup(events: DataFrame) -> DataFrame:
    """Requests by modality and class of status."""
    kind = F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))
    return events.groupBy("modality", kind.alias("status_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_in").alias("bytes_in"), F.max("latency_ms").alias("max_latency"))


def evicted(cache: DataFrame, budget: int) -> DataFrame:
    """cache (tenant_id, id, bytes, at) with kept: the newest entries of each tenant whose bytes fit the budget together; the oldest go first."""
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("at"), F.desc("id"))
    return cache.withColumn("running", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("kept", F.col("running") <= budget)


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= n).drop("r")


def client_errors(errors: DataFrame) -> DataFrame:
    """Reports cut to the lengths that are stored."""
    return errors.select(*[F.substring(c, 1, n).alias(c) for c, n in (("message", 256), ("url", 256), ("agent", 200), ("stack", 1024))])


def manifest(items: DataFrame) -> DataFrame:
    """What a finished upload queue exports."""
    return items.filter("status = 'done' AND record_id IS NOT NULL").select("name", "modality", "record_id", "algorithm")


def status_counts(items: DataFrame) -> DataFrame:
    """How many items of a queue are in each state."""
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def clock(at: Column) -> dict[str, Column]:
    """Of seconds since 1970: the minute, the UTC day as yyyymmdd, and the seconds to the next one."""
    return {"minute": F.floor(at / 60), "day_key": F.date_format(F.timestamp_seconds(at), "yyyyMMdd"), "to_midnight": F.lit(86400) - F.pmod(at, F.lit(86400))}
