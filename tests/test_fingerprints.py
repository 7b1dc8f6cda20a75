"""Kernels against published or brute-force values."""

import numpy as np
import pytest

from contentprint.errors import BadInputError, UnsupportedError
from contentprint.functions import audio, images, manifest, unicode
from contentprint.operators import kernels, media, signatures


def test_minhash_golden():
    got = kernels.minhash_fingerprint("the quick brown fox jumps over the lazy dog")
    assert len(got) == 1032 and got[:16].hex() == "0100000000000000a26accc88c8a8106"


def test_minhash_of_a_union_is_the_minimum():
    a, b = "one two three four five six".split(), "seven eight nine ten eleven twelve".split()
    own = np.minimum(kernels.minhash_slots(a), kernels.minhash_slots(b))
    both = {" ".join(x[i : i + 5]) for x in (a, b) for i in range(2)}
    assert all(len(s.split()) == 5 for s in both) and (own <= kernels.minhash_slots(a)).all()


def test_native_signatures_estimate_jaccard(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:195], "x", "y"])), (3, " ".join(reversed(base))), (4, " ".join(base)), (5, "short text")]
    df = spark.createDataFrame(rows, "record_id long, text string")
    pairs = {(r.a, r.b): r.estimate for r in signatures.lsh_near_duplicates(df).collect()}
    assert set(pairs) == {(1, 2)} and pairs[1, 2] == pytest.approx(191 / 198, abs=0.1)
    assert [r.n for r in signatures.exact_groups(df).collect()] == [2]
    assert sorted(r.record_id for r in signatures.keep_first(df).collect()) == [1, 2, 3, 5]


def test_classes_tell_for_whom_a_record_stands(spark):
    base = [f"w{i}" for i in range(200)]
    turned = [*base[100:], *base[:100]]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:195], "x", "y"])), (4, " ".join(base)), (5, "short text"), (6, "text short"), (7, "short  TEXT"), (8, " ".join(turned)), (9, "")]
    df = spark.createDataFrame(rows, "record_id long, text string")
    signed, hashed = signatures.signatures(df), signatures.simhash(df)
    assert {tuple(r) for r in signatures.signature_classes(signed).collect()} == {(1, 1), (2, 2), (4, 1), (5, 5), (6, 6), (7, 5), (8, 8)}
    assert {tuple(r) for r in signatures.simhash_classes(hashed).collect()} == {(1, 1), (2, 2), (4, 1), (5, 5), (6, 5), (7, 5), (8, 1)}


def test_simhash_pairs_find_all_within_the_radius(spark):
    import random

    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(5)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps] + [f ^ 0xFF for f in fps]
    df = spark.createDataFrame([(i, f >> 32, f & 0xFFFFFFFF) for i, f in enumerate(fps)], "record_id long, hi long, lo long")
    want = {(i, j, (f ^ g).bit_count()) for i, f in enumerate(fps) for j, g in enumerate(fps) if i < j and (f ^ g).bit_count() <= 3}
    assert {tuple(r) for r in signatures.simhash_pairs(df).collect()} == want


def test_tlsh():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    near, far = data[:1000] + b"xx" + data[1000:], bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    a, b, c = map(kernels.tlsh, (data, near, far))
    assert len(a) == 70 and kernels.tlsh_distance(a, a) == 0 and kernels.tlsh_distance(a, b) < 40 < kernels.tlsh_distance(a, c)
    assert kernels.tlsh(b"x" * 49) is None and kernels.tlsh(b"x" * 500) is None


def test_canonical_text():
    assert unicode.canonical("ﬁ Ａ​‮B") == "fi ab"
    assert unicode.canonical("İ", casefold=True, form="none") == "İ"
    assert unicode.canonical("раураl", confusables=True) == "paypal"
    assert unicode.words("It's 3.14, can't") == ["It's", "3.14", "can't"]
    assert unicode.graphemes("é👩‍👩‍👧") == ["é", "👩‍👩‍👧"]
    with pytest.raises(UnsupportedError):
        unicode.tokenizer("cjk-jp")
    with pytest.raises(BadInputError):
        unicode.canonical("x", form="nfd")


def test_sql_functions(spark):
    kernels.register(spark)
    row = spark.sql("SELECT fp_canonicalize('ABC') AS a, fp_tokenize('A b') AS b, length(fp_minhash('x')) AS c, fp_tlsh('short') AS d").collect()[0]
    assert tuple(row) == ("abc", ["a", "b"], 1032, None)


def test_sql_table_functions(spark):
    kernels.register(spark)
    kernels.register_tables(spark)
    rows = spark.sql("SELECT * FROM shingles('a b c', 2)").collect()
    assert [tuple(r) for r in rows] == [(0, "a b"), (1, "b c")]
    assert spark.sql("SELECT count(DISTINCT bucket) AS n FROM lsh_bands(fp_minhash('a b c d e f g'), 16, 8)").collect()[0].n == 16


def ramp(n=64, shift=0):
    y, x = np.mgrid[0:n, 0:n]
    return np.stack([(x + shift) % 256, y % 256, np.full_like(x, 128)], axis=2).astype(np.uint8)


def test_images():
    data = images.encode_png(ramp())
    assert (images.decode_png(data) == ramp()).all() and len(images.bundle(data)) == 536 and len(images.single(data, "phash")) == 168
    assert images.compare(images.bundle(data), images.bundle(data)) == pytest.approx(1)
    other = images.bundle(images.encode_png(ramp()[::-1].copy()))
    assert images.compare(images.bundle(data), other) < 0.8
    assert images.inspect(data)["width"] == 64
    for bad in (b"not an image", data[:60], images.encode_png(ramp(4))):
        with pytest.raises(BadInputError):
            images.bundle(bad)


def test_png_filters():
    import struct
    import zlib

    img, rows, above = ramp(16).reshape(16, -1).astype(int), [], np.zeros(48, int)
    for y, line in enumerate(img):
        kind = y % 5
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), above[:-3]])
        p = left + above - corner
        guess = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows.append(bytes([kind]) + ((line - [0 * left, left, above, (left + above) // 2, guess][kind]) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (images.decode_png(data) == ramp(16)).all()


def sine(seconds, rate=8000, f=440):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(int(seconds * rate)) / rate)


def test_audio(spark):
    t = np.arange(24000) / 8000
    chirp = sum(0.3 * np.sin(2 * np.pi * (400 * k * t + 200 * k * t * t)) * (np.sin(2 * np.pi * (k + 2) * t) > 0) for k in (1, 2, 3))
    shifted = np.concatenate([np.zeros(4096), chirp])
    rows = [(1, chirp), (2, shifted), (3, sine(3, f=1234)), (4, np.zeros(10))]
    clips = spark.createDataFrame([(i, bytearray(x.astype("<f4").tobytes())) for i, x in rows] + [(5, bytearray(b"\0\0\0"))], "record_id long, content binary")
    found = media.landmarks(clips)
    best = {(r.qid, r.record_id): (r.votes, r.offset) for r in media.landmark_matches(found.filter("record_id = 1"), found).collect()}
    assert best[1, 2][1] == 32 and best[1, 2][0] > 0.8 * best[1, 1][0]
    assert best.get((1, 3), (0, 0))[0] < 0.2 * best[1, 1][0]
    words = audio.haitsma(chirp, 8000)
    noisy = audio.haitsma(chirp + 0.001 * np.random.default_rng(0).normal(size=len(chirp)), 8000)
    later = audio.haitsma(np.concatenate([np.zeros(2048), chirp])[: len(chirp)], 8000)
    assert audio.bit_error_rate(words, later) < 0.2 < audio.bit_error_rate(words, audio.haitsma(sine(3, f=1234), 8000))
    assert audio.bit_error_rate(words, words) == 0 and audio.bit_error_rate(words, noisy) < 0.25
    assert len(audio.envelope(chirp)) == 256 and len(audio.panako(chirp)) > 0
    with pytest.raises(BadInputError):
        audio.pcm(b"\0\0\0")
    with pytest.raises(BadInputError):
        audio.wang(chirp, 44100)
    got = {r.record_id: r for r in media.audio_inspect(clips).collect()}
    assert got[1].n_peaks > 0 and len(got[1].envelope) == 256 and got[5].n_peaks is None


def test_bad_media_have_a_status(spark):
    df = spark.createDataFrame([(1, bytearray(b"not an image")), (2, bytearray(images.encode_png(ramp()))), (3, None)], "record_id long, content binary")
    assert {r.record_id: r.status for r in media.image_fingerprint(df).collect()} == {1: 400, 2: 201, 3: 400}


def test_manifest(spark):
    assert manifest.algorithms(spark).count() == 19
    assert manifest.checked("wang", fan_out=3)["target_zone_t"] == 63
    for bad in ({"fan_out": 99}, {"nothing": 1}):
        with pytest.raises(BadInputError):
            manifest.checked("wang", **bad)
