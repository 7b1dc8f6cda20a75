"""Sessions, lookups, readers, providers and comparability."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentprint.errors import BadInputError, IncompatibleError
from contentprint.functions import audio, images
from contentprint.operators import control, fusion, kernels, media, records, signatures
from contentprint.sources import readers
from contentprint.streaming import jobs


def tone(seconds, rate=8000, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    x = sum(np.sin(2 * np.pi * (300 * k + 60 * k * t) * t) * (np.sin(2 * np.pi * (k + 1) * t) > 0) for k in range(1, 6)) + 0.05 * rng.standard_normal(len(t))
    x[:2000] *= 3  # the loudest part comes first, as the floor hangs on what was heard so far
    return x.astype("<f4")


def chunks(spark, tmp_path, parts, name="in"):
    for i, (data, last) in enumerate(parts):
        spark.createDataFrame([("s", i, bytearray(data), last)], "session string, chunk_no long, content binary, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema("session string, chunk_no long, content binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_audio_sessions_give_what_the_whole_clip_gives(spark, tmp_path):
    raw = tone(9).tobytes()
    edges = [0, 40_001, 90_000, 150_003, 230_000, len(raw)]
    parts = [(raw[a:b], b == len(raw)) for a, b in zip(edges, edges[1:])]
    got = jobs.drained(jobs.wang_sessions(chunks(spark, tmp_path, parts)), "append").collect()
    assert sorted((r.hash, r.t) for r in got) == sorted(audio.wang(audio.pcm(raw)))


def test_an_ended_session_has_no_state(spark, tmp_path):
    schema = "session string, chunk_no long, text string, last boolean"
    for i, (text, last) in enumerate((("one two three four ", False), ("five six", True), ("seven eight nine ten eleven", True))):
        spark.createDataFrame([("s", i, text, last)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = {(r.n_chunks, bytes(r.fingerprint)) for r in jobs.drained(jobs.minhash_sessions(stream), "update").collect()}
    assert (2, kernels.minhash_fingerprint("one two three four five six")) in got and (1, kernels.minhash_fingerprint("seven eight nine ten eleven")) in got


def test_token_buckets_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, 1_700_000_000 + i // 3, rng.choice([1, 1, 2, 9])) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, id long, at long, cost int")
    want = {(r.key, r.id): r.allowed for r in control.token_bucket(df.withColumn("ts_ms", F.col("at") * 1000), rps=0.7, burst=4).collect()}
    level, last, brute = {}, {}, {}
    for key, i, at, cost in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        have = min(4.0, level.get(key, 4.0) + (at - last.get(key, at)) * 0.7)
        brute[key, i] = cost <= 4 and have >= cost
        level[key], last[key] = have - cost * brute[key, i], at
    assert want == brute
    df.select("key", "id", F.timestamp_seconds("at").alias("ts"), "cost").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("key string, id long, ts timestamp, cost int").parquet(str(tmp_path / "r"))
    assert {(r.key, r.id): r.allowed for r in jobs.drained(jobs.token_buckets(stream, 0.7, 4.0), "append").collect()} == want


def test_a_stream_that_does_not_end_is_stopped(spark, tmp_path):
    import time

    def slow(batches):
        for pdf in batches:
            time.sleep(20)
            yield pdf

    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "e")).mapInPandas(slow, "id long")
    with pytest.raises(TimeoutError):
        jobs.drained(stream, "append", seconds=1)


def test_lookups_and_sources_of_keys(spark):
    now, asked = [0.0], []
    cache = control.CachedLookup(lambda t: asked.append(t) or ({"id": t} if t != "no" else None), ttl=60, most=2, clock=lambda: now[0])
    assert cache.lookup("a") == {"id": "a"} == cache.lookup("a") and cache.lookup("no") is None is cache.lookup("no") and asked == ["a", "no"]
    cache.lookup("b")
    assert len(cache.held) == 1
    now[0] = 61
    cache.lookup("b")
    assert asked == ["a", "no", "b", "b"]
    assert control.key_source({"token": "t", "file": " ", "webhook": ""}) == ("token", "t") and control.key_source({"token": "t", "file": "f"}) == ("file", "f")
    with pytest.raises(BadInputError):
        control.key_source({})
    keys = control.keys_from_json(spark, json.dumps([{"token": "t", "tenant_id": 3, "key_id": "k"}]))
    assert keys.first().tenant_id == 3
    for bad in ("{", "{}", "[1]", '[{"token": "t"}]'):
        with pytest.raises(BadInputError):
            control.keys_from_json(spark, bad)
    own = spark.createDataFrame([(1, 5, None), (2, 5, 9)], "key_id long, user_id long, revoked_at int")
    assert control.revoked(own, 1, 5) and not control.revoked(own, 2, 5) and not control.revoked(own, 1, 6)


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.ndjson").write_text('"b"\r\n\n"a"\n{"x":1}\n')
    got = [(r.line_no, r.status, r.chunk) for r in readers.ndjson_chunks(spark, str(tmp_path / "n")).orderBy("line_no").collect()]
    assert got == [(0, 200, "b"), (2, 200, "a"), (3, 400, None)]
    for i, data in enumerate((b"\0" * 8, b"\0" * 7)):
        (tmp_path / "up/s1").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"up/s1/{i}.f32").write_bytes(data)
    assert sorted((r.session, r.chunk_no, r.status) for r in readers.audio_chunks(spark, str(tmp_path / "up")).collect()) == [("s1", 0, 200), ("s1", 1, 400)]
    y, x = np.mgrid[0:40, 0:30]
    rgb = np.stack([x * 8, y * 6, (x + y) * 3], axis=2).astype(np.uint8)
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.png").write_bytes(images.encode_png(rgb))
    (tmp_path / "p/b.png").write_bytes(images.encode_png(rgb[:4]))
    (tmp_path / "p/c.png").write_bytes(b"no picture")
    found = {r.path.rsplit("/", 1)[1]: r for r in readers.decoded_images(spark, str(tmp_path / "p")).collect()}
    assert (images.decode_png(bytes(found["a.png"].content)) == rgb).all() and found["b.png"].status == 400 == found["c.png"].status and found["c.png"].content is None


def test_dropped_events_are_counted(spark, tmp_path):
    def poster(body):
        if '"id": 39' in body:
            raise OSError("never")

    sink = readers.webhook(poster, batch=32, sleep=lambda s: None)
    sink(spark.range(0, 40, 1, 1), 7)
    assert sink.lost == {7: 8}
    readers.webhook(poster, batch=32, sleep=lambda s: None, dropped=str(tmp_path / "lost"))(spark.range(0, 40, 1, 1), 8)
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "lost")).collect()) == list(range(32, 40))


def test_bulk_and_health(spark, tmp_path):
    (tmp_path / "b.json").write_text("".join(json.dumps({"tenant_id": 1, "record_id": i, "modality": "Text", "fingerprint": [1, 255], "text": "x"}) + "\n" for i in (1, 2, 2)))
    store = records.Store(spark, str(tmp_path / "s"))
    assert store.healthy()
    assert store.bulk(str(tmp_path / "b.json")) == {"upserted": 2, "version": 1} and store.healthy()
    assert {(r.record_id, bytes(r.fingerprint), r.text) for r in store.read().collect()} == {(1, b"\x01\xff", None), (2, b"\x01\xff", None)}


def test_comparability(spark):
    kind = "struct<algorithm:string,format_version:int,config_hash:bigint>"
    pairs = spark.createDataFrame([(("a", 1, 5), ("a", 1, 5)), (("a", 1, None), ("a", 1, None)), (("a", 1, 5), ("a", 2, 5))], f"a {kind}, b {kind}")
    assert [r.status for r in records.compared(pairs).collect()] == [200, 200, 409]
    with pytest.raises(IncompatibleError):
        records.compared(pairs, strict=True)
    assert records.compared(pairs.limit(2), strict=True).count() == 2


def test_providers(spark):
    clips = spark.createDataFrame([(1, bytearray(tone(0.5, 16000).tobytes())), (2, bytearray(b"abc")), (3, None)], "record_id long, content binary")
    got = {r.record_id: r for r in media.watermark(clips, lambda x: (0.9 if len(x) > 100 else 0.1, 258)).collect()}
    assert got[1].detected and bytes(got[1].payload) == b"\x02\x01\0\0" and not got[2].detected and got[3].payload is None

    class Lengths(kernels.EmbeddingProvider):
        model_id = "lengths"

        def embed(self, items):
            return np.array([[len(x or b""), 1] for x in items], np.float32)

    assert {r.record_id: r.embedding[0] for r in media.semantic(clips, Lengths()).collect()} == {1: 32000.0, 2: 3.0, 3: 0.0}
    assert media.neural(clips, Lengths(), 16000).first().fmax == 8000
    for rate, fmax in ((8000, None), (16000, 9000.0)):
        with pytest.raises(BadInputError):
            media.neural(clips, Lengths(), rate, fmax)


PDF = b"%PDF-1.4\n1 0 obj << /Length 44 >> stream\nBT /F1 12 Tf (Hello from a page) Tj ET\nendstream endobj"


def test_uploads_and_inspection(spark):
    df = spark.createDataFrame([(1, bytearray(PDF)), (2, bytearray(b"junk")), (3, None)], "record_id long, content binary")
    got = {r.record_id: r for r in kernels.prepared_fingerprint(df, "pdf").collect()}
    assert got[1].text == "Hello from a page" and bytes(got[1].fingerprint) == kernels.minhash_fingerprint("Hello from a page") and got[2].status == 400 == got[3].status and got[2].fingerprint is None
    pages = spark.createDataFrame([(1, bytearray(b"<b>A</b> c")), (2, bytearray(b"\x80"))], "record_id long, content binary")
    assert [(r.text, r.status) for r in kernels.prepared(pages, "html").collect()] == [("A c", 200), (None, 400)]
    with pytest.raises(BadInputError):
        kernels.prepared(pages, "docx")
    texts = [(1, "Ａ quick BROWN fox " * 900), (2, None), (3, "é" * 5000)]
    for r in kernels.inspected(spark.createDataFrame(texts, "record_id long, text string")).collect():
        whole = texts[r.record_id - 1][1] or ""
        words = kernels.tokenizer("word")(kernels.canonical(whole))
        assert r.n_tokens == len(words) and r.tokens == words[:256] and len(r.raw.encode()) <= 8192 and whole.startswith(r.raw) and kernels.canonical(whole).startswith(r.canonical)
        assert r.n_shingles == (max(1, len(words) - 4) if words else 0) and r.shingles == [" ".join(words[i : i + 5]) for i in range(min(256, r.n_shingles))]
        assert bytes.fromhex(r.fingerprint) == kernels.minhash_fingerprint(whole) and r.config_hash is not None


def test_tlsh_under_another_table():
    data = bytes(np.random.default_rng(2).integers(97, 123, 2000).astype(np.uint8))
    table = np.random.default_rng(0).permutation(256)
    a, b = kernels.tlsh(data), kernels.tlsh(data, table)
    assert a != b and len(b) == 70 and kernels.tlsh_distance(b, kernels.tlsh(data[:1990], table)) < 40


def test_recall_of_the_bands(spark):
    """Pairs of a similarity of 0.8 and more meet in a band nine times out of ten or more."""
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        other = list(words)
        for _ in range(rng.choice([1, 2])):
            other[rng.randrange(len(other))] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({" ".join(w[j : j + 5]) for j in range(116)} for w in (words, other))
        if len(a & b) >= 0.8 * len(a | b):
            want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "record_id long, text string")
    found = {(r.a, r.b) for r in signatures.lsh_candidates(signatures.signatures(df)).collect()}
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)


def test_bit_errors_of_any_shared_passage():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 2**32, 300, dtype=np.uint32)
    a, b = (np.concatenate([rng.integers(0, 2**32, n, dtype=np.uint32), shared, rng.integers(0, 2**32, m, dtype=np.uint32)]) for n, m in ((400, 30), (90, 600)))
    assert audio.bit_error_rate(a, b) == 0 == audio.bit_error_rate(b, a) and audio.bit_error_rate(a, a[::-1].copy()) > 0.4


def test_matches_of_few_votes_go(spark):
    index = spark.createDataFrame([(r, h, t) for r, n in ((1, 9), (2, 2), (3, 6)) for h, t in ((100 + i, 10 * r + i) for i in range(n))], "record_id long, hash long, t int")
    asked = spark.createDataFrame([(7, 100 + i, i) for i in range(9)], "record_id long, hash long, t int")
    assert {(r.record_id, r.votes, r.offset) for r in media.landmark_matches(asked, index).collect()} == {(1, 9, 10), (2, 2, 20), (3, 6, 30)}
    assert {r.record_id for r in media.landmark_matches(asked, index, least=3).collect()} == {1, 3}
    assert [r.record_id for r in media.landmark_matches(asked, index, k=1).collect()] == [1]


def test_requests(spark):
    rows = [(1, 1, [1.0, 2.0], 0), (2, 1, None, 5), (3, 1, [float("inf")], None), (4, 1, [], 500), (5, 1, [1.0], None)]
    got = [(r.qid, r.k, r.status) for r in fusion.requested(spark.createDataFrame(rows, "qid long, tenant_id long, vector array<double>, k int")).orderBy("qid").collect()]
    assert got == [(1, 1, 200), (2, 5, 400), (3, 10, 400), (4, 100, 400), (5, 10, 200)]


def test_more_queries_than_are_held_at_once(spark):
    from contentprint.operators import knn

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))], "tenant_id long, record_id long, embedding array<float>")
    asked = df.select(F.col("record_id").alias("qid"), "tenant_id", F.col("embedding").alias("vector"), F.lit(3).alias("k"))
    whole, parts = (sorted((r.qid, r.rank, r.record_id) for r in knn.search(df, asked, most_queries=n).collect()) for n in (100, 13))
    assert whole == parts and len(whole) == 180


def test_a_tenant_reads_its_own_folder(spark, tmp_path):
    from decimal import Decimal

    rows = [(t, i, "Text", 1, "a", Decimal(1), b"x", None, None, None, "t") for t in (1, 2) for i in range(3)]
    store = records.Store(spark, str(tmp_path / "s"))
    store.commit(spark.createDataFrame(rows, records.SCHEMA))
    own = store.read().filter("tenant_id = 2")
    assert own.count() == 3 and "PartitionFilters: [isnotnull(tenant_id" in own._jdf.queryExecution().toString()


def test_inspection_of_clips_and_differences(spark):
    from contentprint.functions.documents import diff_spans, differences

    clips = spark.createDataFrame([(1, bytearray(tone(2).tobytes())), (2, bytearray(b"abc"))], "record_id long, content binary")
    got = {r.record_id: r for r in media.audio_inspect(clips).collect()}
    found = audio.peaks(audio.pcm(tone(2).tobytes()))
    assert got[1].n_peaks == len(found) and got[1].peaks[0].t_ms == found[0][0] * 16 and got[1].peaks[0].hz == found[0][1] * 7.8125
    assert images.decode_png(bytes(got[1].spectrum)).shape[2] == 3 and got[2].peaks is None
    df = spark.createDataFrame([("abc", "abd"), (None, "x")], "a string, b string")
    assert [[tuple(x) for x in r[0]] for r in df.select(differences("a", "b")).collect()] == [diff_spans("abc", "abd"), [("added", "x")]]


def test_small_parts(spark, tmp_path):
    from contentprint.functions import vectors
    from contentprint.operators import bm25, usage

    (tmp_path / "a.f32").write_bytes(b"\0" * 8)
    (tmp_path / "b.f32").write_bytes(b"\0" * 6)
    assert sorted(r.status for r in readers.pcm_files(spark, str(tmp_path)).collect()) == [200, 400]
    df = spark.createDataFrame([(list(range(10)),), ([1, 2],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(vectors.subsample(F.col("v"), 4)).collect()] == [[0, 2, 5, 7], [1, 2], []]
    items = spark.createDataFrame([("x", "text", 1, "a", "done"), ("y", "text", None, "a", "done"), ("z", "text", 3, "a", "failed")], "name string, modality string, record_id long, algorithm string, status string")
    readers.export_manifest(usage.manifest(items), str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "m")).select("name", "record_id").collect()] == [("x", 1)]
    texts = spark.createDataFrame([(1, 1, "b a b"), (1, 2, None), (0, 3, "c A")], "tenant_id long, record_id long, text string")
    assert [tuple(r) for r in bm25.term_dictionary(texts).collect()] == [(0, "a"), (0, "c"), (1, "a"), (1, "b")]


def test_fixed_windows_of_a_stream(spark, tmp_path):
    rows = [(u, 1_700_000_000 + 17 * i) for i in range(40) for u in (i % 3,)]
    spark.createDataFrame(rows, "user_id long, at long").select("user_id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "w"))
    got = {(r.user_id, int(r.w.timestamp())): r.n for r in jobs.drained(jobs.fixed_windows(stream).select("user_id", F.col("window.start").alias("w"), "n"), "complete").collect()}
    want = {}
    for u, at in rows:
        want[u, at // 60 * 60] = want.get((u, at // 60 * 60), 0) + 1
    assert got == want


def test_made_clips_come_few_at_a_time(spark, tmp_path):
    from contentprint.plans import media_queries

    spark.range(600).select(F.col("id").alias("page_id")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows], "b": [batch.nbytes], "ids": [batch["record_id"].to_pylist()]})

    got = media_queries._made(spark, str(tmp_path), media_queries.clip).mapInArrow(sizes, "n long, b long, ids array<long>").collect()
    assert sorted(i for r in got for i in r.ids) == list(range(600)) and max(r.b for r in got) < 6 << 20


def test_inspection_shows_what_the_parts_give(spark):
    from contentprint.functions.documents import spectrum_png

    rng = np.random.default_rng(8)
    made = {1: tone(3), 2: rng.normal(size=9000).astype("<f4"), 3: np.zeros(3000, "<f4"), 4: np.zeros(0, "<f4"), 5: np.full(2000, np.nan, "<f4")}
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    clips = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in made.items()], "record_id long, content binary")
    got = {r.record_id: r for r in media.audio_inspect(clips).collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    for i, x in made.items():
        x = audio.pcm(x.tobytes())
        assert (got[i].n_hashes, got[i].n_peaks) == (len(audio.wang(x)), len(audio.peaks(x))) and got[i].frames == len(audio.spectrum(x, hop=256))
        assert bytes(got[i].spectrum) == spectrum_png(audio.decibel(audio.spectrum(x)))
    edges = np.linspace(0, 9000, 257).astype(int)
    assert got[2].envelope == [float(np.abs(made[2][a:b].astype(float)).max()) for a, b in zip(edges, edges[1:])]
    assert got[5].n_peaks == 0 and got[4].envelope == [0.0] * 256


def test_marks_of_clips_are_one_row_a_clip(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    made = [tone(2), np.random.default_rng(9).normal(size=12000).astype("<f4"), np.zeros(4000, "<f4")]
    rows = [(i, bytearray(made[i % 3].tobytes())) for i in range(40)] + [(40, bytearray(b"abc")), (41, None)]
    clips = spark.createDataFrame(rows, "record_id long, content binary")
    for name, f in (("wang", audio.wang), ("panako", audio.panako)):
        want = [[tuple(x[:2]) for x in f(audio.pcm(m.tobytes()))] for m in made]
        got = {r.record_id: r for r in media.landmark_sets(clips, name).collect()}
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
        assert all(list(zip(got[i].hashes, got[i].times)) == want[i % 3] for i in range(40)) and got[40].hashes == got[41].hashes == []
        assert len({bytes(r.digest) for r in got.values()}) == 3
        assert media.landmarks(clips, name).count() == sum(len(want[i % 3]) for i in range(40))


def test_copies_of_clips_take_their_places(spark):
    rng = np.random.default_rng(10)
    kinds = [[(int(h), int(t)) for h, t in zip(rng.integers(0, 6, 8), rng.integers(0, 5, 8))] for _ in range(9)] + [[]]
    rows = [(int(i), bytes([k]), [h for h, _ in kinds[k]], [t for _, t in kinds[k]]) for i, k in zip(rng.permutation(120), rng.integers(0, 10, 120))]
    sets = spark.createDataFrame(rows, "record_id long, digest binary, hashes array<long>, times array<int>").cache()
    for k, least in ((1, 1), (4, 3), (25, 1)):
        asked = sets.filter("record_id % 7 = 0")
        want = media.landmark_matches(media.exploded(asked), media.exploded(sets), least, k)
        got = media.landmark_set_matches(asked, sets, k, least)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_visit_at_the_end_begins_a_session(spark, tmp_path):
    rows = [(1, 0.0), (1, 21599.7), (2, 0.0), (2, 21601.0), (3, 0.0), (3, 21602.0), (4, 5.0), (4, None), (4, None), (None, 0.0), (None, 9.0), (5, -1.5)]
    df = spark.createDataFrame(rows, "user_id long, at double").select("user_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
    events = df.selectExpr("1L AS event_id", "ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    from contentprint import registry

    got = registry.QUERIES["session_expiry"](spark, str(tmp_path))
    want = [(1, 0, 43200, 2), (2, 0, 21601, 1), (2, 21601, 43202, 1), (3, 0, 21601, 1), (3, 21602, 43203, 1), (4, 5, 21606, 1), (4, None, None, 1), (4, None, None, 1), (None, 0, 21610, 2), (5, -2, 21599, 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
