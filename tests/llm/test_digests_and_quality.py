import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from contentprint.llm import cotrain
from contentprint.llm.cotrain import Settings, score_quality
from contentprint.llm.fingerprints import Digester, compare_neighbours, entropy_levels, fingerprint, likeness, rarity_ranks


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwéø") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_entropy_of_every_window():
    buf = np.frombuffer((prose(random.Random(1), 60) + "a" * 200).encode(), np.uint8)
    for i, level in enumerate(entropy_levels(buf)):
        p = np.bincount(buf[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(level - max(0, -(p * np.log2(p)).sum()) / 6 * 1000) <= 1.01


def test_digests_do_not_depend_on_their_neighbours():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 300)).encode() for _ in range(30)] + [b"", b"short", b"a" * 900]
    digest = Digester(np.arange(1001))
    together = digest(texts)
    assert together == [digest([t])[0] for t in texts]
    assert together[30] == b"" and len(together[31]) == 256 == len(together[32])


def test_likeness_follows_what_is_shared():
    rng = random.Random(3)
    digest = Digester(np.random.default_rng(0).permutation(1001))
    a, b = prose(rng, 3000), prose(rng, 3000)
    x, y, z = digest([a.encode(), (a[: len(a) // 2] + b[: len(b) // 2]).encode(), b.encode()])
    assert likeness(x, x) == 1 and 0.35 < likeness(x, y) < 0.75 and likeness(x, z) < 0.15 and likeness(x, y) == likeness(y, x)
    assert likeness(b"", b"") == 1 and likeness(x, b"") == 0


def test_short_texts_are_alike_in_part():
    rng = random.Random(6)
    digest = Digester(np.random.default_rng(0).permutation(1001))
    near, far = [], []
    for _ in range(40):
        a, b = prose(rng, 14)[:90], prose(rng, 14)[:90]
        x, y, z = digest([a.encode(), (a[:45] + b[:45]).encode(), b.encode()])
        near.append(likeness(x, y))
        far.append(likeness(x, z))
    assert 0.2 < np.median(near) < 0.8 and np.median(far) < 0.1


def test_every_document_meets_the_next(spark, docs):
    rng = random.Random(4)
    rows = [(i * 7 % 400, prose(rng, rng.randrange(1, 60))) for i in range(150)] + [(900, None), (901, ""), (5, "equal ids"), (5, "equal"), (None, "without"), (902, "y" * 150_000)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    df = docs(rows).repartition(5).withColumn("Bucket", F.lit(1)).withColumn("guest", F.lit(1))
    got = compare_neighbours(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    digest = Digester(rarity_ranks(df))
    texts = {d: t for d, t in rows if d != 5}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id != 5:
            assert r.fingerprint == digest([(texts[r.doc_id] or "").encode()])[0].hex()
    assert fingerprint(df).count() == len(rows)


def test_one_document_and_none(docs):
    row = compare_neighbours(docs([(1, "some text of a document " * 9)])).collect()
    assert len(row) == 1 and row[0].near_next == 1
    assert compare_neighbours(docs([])).count() == 0


LABEL = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = prose(rng, rng.randrange(20, 80)).split()
        text = " ".join(words if good else [w + rng.choice(["***", "&&&", "!!"]) for w in words])
        rows.append((i, text, "en", f"src{rng.randrange(6)}" if rng.random() < 0.3 else ("good" if good else "bad")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_cotraining_scores_unlabelled_documents(spark, docs):
    rows, labels = corpus()
    odd = [(900, None, None, None), (901, ""), (None, "no id at all"), rows[0], (902, "word " * 40_000)]
    df = docs([*rows, *odd]).withColumn("SCORE", F.lit(1)).withColumn("quality", F.lit(0))
    known = spark.createDataFrame([*labels[:120], (5, labels[5][1], 0), (7, None, 0), (None, 1, 0), (8, 9, 0)], LABEL)
    got = score_quality(df, known, Settings(labelled_docs=100, pool_docs=200, per_round=30)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    right = [by[i].quality_pred == y for i, y, _ in labels[120:]]
    assert sum(right) > 0.95 * len(right)
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.meta_score, r.score))


def test_without_labels_nothing_is_known(spark, docs):
    none = spark.createDataFrame([], LABEL)
    assert {r.score for r in score_quality(docs([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert score_quality(docs([]), none).count() == 0


def test_pseudo_labels_come_from_all_unlabelled_documents(spark, docs):
    rows, labels = corpus()
    odd = [(None, "no id at all", "en", "good"), rows[200], (200, "another text", "en", "bad")]
    known = spark.createDataFrame([(i, y) for i, y, _ in labels[:120]], "doc_id long, quality int")
    s = Settings(labelled_docs=100, pool_docs=10, per_round=1000, confident=0.6)
    made = cotrain.features(docs([*rows, *odd]).select("doc_id", "text", "lang", "source", "n_chars"), s).cache()
    model = cotrain.train(made, known, s)
    views = [model.text, model.meta]
    got = cotrain._sure(made, known, views, [{}, {}], s)
    p = {}
    for r in made.collect():
        if r.doc_id is None or r.doc_id >= 120:
            pair = cotrain._pair(r)
            p.setdefault(r.key if r.doc_id is None else r.doc_id, []).append([cotrain.sigmoid(v.margin(*pair[i])) for i, v in enumerate(views)])
    assert len(p) == 281
    for v in (0, 1):
        assert set(got[v]) == {i for i, own in p.items() if any(max(x[v], 1 - x[v]) >= 0.6 for x in own)} and len(got[v]) > 100
    few = cotrain._sure(made, known, views, [{i: None for i in got[1]}, {}], Settings(per_round=7, confident=0.6))
    assert not few[1] and len(few[0]) == 14
    best = sorted((max(x[0] for x in own) for own in p.values()), reverse=True)[:7]
    assert all(max(x[0] for x in p[i]) >= best[-1] - 1e-9 for i, (y, _) in few[0].items() if y)


def brute_features(text, ranks, window):
    """Windows that rank first in a quarter of the stretches of `window` neighbouring places that reach over them."""
    n = len(text) - window + 1
    if n < 1:
        return []
    levels = entropy_levels(np.frombuffer(text, np.uint8), window)
    rank = [int(ranks[x]) if x >= 100 else None for x in levels]
    first = [0] * n
    for s in range(-window + 1, n):
        held = [(rank[i], i) for i in range(max(0, s), min(n, s + window)) if rank[i] is not None]
        if held:
            first[min(held)[1]] += 1
    return [text[i : i + window] for i in range(n) if first[i] >= window // 4]


def brute_bits(features):
    out = []
    for at in range(0, len(features), 160):
        bits = set()
        for f in features[at : at + 160]:
            h = 0x2545F4914F6CDD1D
            for j in range(0, len(f), 8):
                h = (h ^ int.from_bytes(f[j : j + 8], "little")) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            h = (h ^ (h >> 32)) * 0xBF58476D1CE4E5B9 % 2**64
            h ^= h >> 31
            bits |= {h >> (11 * j) & 2047 for j in range(5)}
        out.append(bits)
    return out


def test_digests_and_likeness_equal_brute_force():
    rng = random.Random(9)
    ranks = np.random.default_rng(3).permutation(1001)
    a = prose(rng, 900)
    texts = [a.encode(), (a[:2500] + prose(rng, 300)).encode(), prose(rng, 40).encode(), (prose(rng, 20) + a[:150]).encode(), b"a" * 300 + prose(rng, 30).encode()]
    made = Digester(ranks)(texts)
    bits = []
    for text, digest in zip(texts, made, strict=True):
        want = brute_bits(brute_features(text, ranks, 64) + (brute_features(text, ranks, 16) if len(text) < 1024 else []))
        flat = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 256), axis=1)
        assert [set(np.flatnonzero(row).tolist()) for row in flat] == want
        bits.append(want)
    for i, x in enumerate(bits):
        for j, y in enumerate(bits):
            short, long_ = (x, y) if (len(x), made[i]) <= (len(y), made[j]) else (y, x)
            total = 0.0
            for p in short:
                scores = [min(1, max(0, (len(p & q) - len(p) * len(q) / 2048) / (min(len(p), len(q)) - len(p) * len(q) / 2048))) for q in long_]
                total += len(p) * max(scores)
            assert abs(likeness(made[i], made[j]) - total / sum(map(len, short))) < 1e-4
