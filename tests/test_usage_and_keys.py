import datetime

import pytest
from pyspark.sql import functions as F

from contentprint.errors import STATUS, BadInputError
from contentprint.functions import text
from contentprint.operators import control, usage
from contentprint.sources import readers
from contentprint.streaming import jobs

EVENT = "id long, user_id long, modality string, status int, bytes_in long, latency_ms double, created_at long"
DAY = 86400


def events(spark):
    return spark.createDataFrame([(1, 1, "text", 200, 5, 4.0, 0), (2, 1, "image", 500, 7, 20.0, DAY - 1), (3, 2, "text", 404, 1, 2000.0, DAY)], EVENT)


def test_rollups(spark):
    got = usage.summary(events(spark), 0).collect()[0]
    assert (got.total, got.text, got.image, got.audio, got.errors) == (3, 2, 1, 0, 2)
    assert tuple(usage.summary(events(spark), 10**9).collect()[0]) == (0, 0, 0, 0, 0)
    days = {r.day: (r.text, r.image, r.audio) for r in usage.pivot(events(spark), 0).collect()}
    assert days == {datetime.date(1970, 1, 1): (1, 1, 0), datetime.date(1970, 1, 2): (1, 0, 0)}
    assert [r.id for r in usage.recent(events(spark), 2).collect()] == [3, 2]
    assert usage.latency_histogram(events(spark)).filter("le IS NULL").count() == 1
    assert [usage.days(x) for x in ("7", "0", "x", None, "9999")] == [7, 30, 30, 30, 365]


def test_windows_and_budgets(spark):
    asked = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 1, 59, 60))], "key string, ts long, id long")
    assert [r.allowed for r in usage.fixed_window(asked, 2).orderBy("id").collect()] == [True, True, False, True]
    cache = spark.createDataFrame([(1, 1, 50, 1), (1, 2, 60, 2), (1, 3, 30, 3)], "tenant_id long, id long, bytes long, at long")
    assert {r.id for r in usage.evicted(cache, 100).filter("kept").collect()} == {2, 3}


def test_token_bucket(spark):
    rows = [("a", i, 0, 1) for i in range(4)] + [("a", 9, 1000, 1), ("b", 1, 0, 5)]
    df = spark.createDataFrame(rows, "key string, id long, ts_ms long, cost int")
    got = {(r.key, r.id): (r.allowed, r.retry_after_ms) for r in control.token_bucket(df, rps=1, burst=3).collect()}
    assert got["a", 2] == (True, 0) and got["a", 3] == (False, 1000) and got["a", 9] == (True, 0) and not got["b", 1][0]


def test_keys(spark):
    toml = '[[key]]\ntoken = "t1"\ntenant_id = 7\nkey_id = "k"\nscopes = ["read"]\n'
    assert control.keys_from_toml(spark, toml).collect()[0].scopes == ["read"]
    with pytest.raises(BadInputError):
        control.keys_from_toml(spark, '[[key]]\ntenant_id = 1\n')
    keys = control.StaticKeys([{"token": "t1", "tenant_id": 7}])
    assert keys.lookup("t1")["tenant_id"] == 7 and keys.lookup("t2") is None
    assert STATUS["ForbiddenError"] == 403


def test_names(spark):
    df = spark.createDataFrame([("héllo wörld", "Bearer  x ", None, "image/png", "a"), ("ab", "Basic y", " k ", None, "Song.MP3"), ("", None, " ", None, "none")], "t string, auth string, key string, mime string, name string")
    got = df.select(text.truncated(F.col("t"), 2).alias("s"), text.bearer(F.col("auth"), F.col("key")).alias("b"), text.modality(F.col("mime"), F.col("name")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("h…", "x", "image"), ("ab", "k", "audio"), ("", None, None)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("hé".encode())
    (tmp_path / "t/b.txt").write_bytes(b"\x80")
    assert sorted((r.status, r.text) for r in readers.text_files(spark, str(tmp_path / "t")).collect()) == [(200, "hé"), (400, None)]
    (tmp_path / "c.ndjson").write_text('"one \\"x\\""\r\n\n{"a":1}\n')
    assert sorted((r.status, r.chunk) for r in readers.ndjson_chunks(spark, str(tmp_path / "c.ndjson")).collect()) == [(200, 'one "x"'), (400, None)]
    log = spark.createDataFrame([(1, "k", "ingest", None, None, 5, 1, 3, 200, datetime.datetime(2024, 1, 1))], readers.EVENT.replace(" ts long", " ts timestamp"))
    readers.append_usage(log, str(tmp_path / "log"))
    readers.append_usage(log, str(tmp_path / "log"))
    assert readers.usage_log(spark, str(tmp_path / "log")).filter("ts = '2024-01-01'").count() == 2


def test_webhook_retries(spark, tmp_path):
    target = str(tmp_path)

    def poster(body, target=target):
        import json
        import os
        import uuid

        if not os.path.exists(f"{target}/failed"):
            open(f"{target}/failed", "w").close()
            raise OSError("once")
        with open(f"{target}/{len(json.loads(body))}-{uuid.uuid4().hex}", "w"):
            pass

    readers.webhook(poster, batch=32, sleep=lambda s: None)(spark.range(0, 40, 1, 1), 0)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["32", "8", "failed"]


def test_streams(spark, tmp_path):
    whole = "the quick brown fox jumps over the lazy dog and runs far away"
    for n, (a, b) in enumerate(((0, 13), (13, 30), (30, 99))):
        spark.createDataFrame([("s", n, whole[a:b])], "session string, chunk_no long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, chunk_no long, text string").parquet(str(tmp_path / "in"))
    from contentprint.operators.kernels import minhash_fingerprint

    rows = jobs.drained(jobs.minhash_sessions(stream), "update").collect()
    assert bytes(max(rows, key=lambda r: r.n_chunks).fingerprint) == minhash_fingerprint(whole)
    asked = stream.select(F.col("session").alias("key"), F.col("chunk_no").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(1).alias("cost"))
    got = jobs.drained(jobs.token_buckets(asked, rps=1, burst=2), "append").collect()
    assert sorted((r.id, r.allowed) for r in got) == [(0, True), (1, True), (2, False)]
