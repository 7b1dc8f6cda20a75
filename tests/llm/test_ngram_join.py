import random

from pyspark.sql import functions as F

import numpy as np

from contentprint.llm.ngram_join import Shingler, _sketch, link_documents, may_be_similar, prefix_length, similar


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def sample(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return [*rows, (3, rows[3][1]), (900, None), (901, " \t\n"), (902, ""), (903, "Two Words"), (904, "two  words"), (None, rows[0][1]), (None, "alone here now yes"), (905, "long text " * 20_000)]


def test_equals_brute_force(docs):
    for k, num, den in ((4, 85, 100), (5, 80, 100), (2, 60, 100)):
        rows = sample(k)
        df = docs(rows).withColumn("Doc_ID2", F.lit(1)).withColumn("node", F.lit(1))
        got = sorted([tuple(r) for r in link_documents(df, k, num, den).select("doc_id", "n_shingles", "component_id").collect()], key=str)
        assert got == brute(rows, k, num, den)


def test_empty_table(docs):
    assert link_documents(docs([])).count() == 0
    assert [tuple(r) for r in link_documents(docs([(1, None)])).collect()] == [(1, 0, 1)]


def test_split_and_dealt_buckets_lose_no_link(docs):
    """Every bucket of more than one class is split by further n-grams, and every one is dealt to several tasks."""
    rows = sample(22, 50)
    got = sorted([tuple(r) for r in link_documents(docs(rows), 1, 60, 100, small_bucket=4, hot_code=0).collect()], key=str)
    assert got == brute(rows, 1, 60, 100)


def test_one_ngram_in_all_documents(docs):
    rng = random.Random(8)
    common = "this passage stands in every single document of the table"
    rows = [(i, f"{common} {' '.join(rng.choice('abcdefghijklmnop') for _ in range(rng.randrange(3, 9)))}") for i in range(250)]
    got = sorted([tuple(r) for r in link_documents(docs(rows), 1, 80, 100, small_bucket=16, hot_code=0).collect()], key=str)
    assert got == brute(rows, 1, 80, 100)


def test_rows_keep_their_key_and_group(docs):
    rows = [(1, "a b c d e f"), (1, "other words than those here"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    out = link_documents(docs(rows).selectExpr("*", "CAST(length(text) AS LONG) AS own", "1 AS KEY", "2 AS group"), key="own")
    got = {(r.doc_id, r.key): r.group for r in out.collect()}
    assert len(got) == 5 and got[1, 11] == got[None, 11] == got[2, 11] != got[1, 27] and got[3, None] is None and got[1, 27] is not None


def test_exact_threshold():
    s = Shingler(1)
    a, b = s(b" ".join(b"x%d" % i for i in range(17))), s(b" ".join(b"x%d" % i for i in range(20)))
    assert similar(a, b, 85, 100) and not similar(a[:-1], b, 85, 100)


def test_suffix_filter_loses_nothing():
    rng = np.random.default_rng(2)
    ruled_out = 0
    for _ in range(400):
        base = rng.integers(0, 2**62, 60).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([base[: rng.integers(45, 60)], rng.integers(0, 2**62, rng.integers(0, 12)).astype(np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in "ab")
        order = rng.permutation(np.union1d(a, b))
        x, y = (order[np.isin(order, s)] for s in (a, b))
        shared = np.flatnonzero(np.isin(x, y))[0]
        i, j = int(shared), int(np.flatnonzero(y == x[shared])[0])
        sides = [(len(s), _sketch(s), (o[: max(at + 1, prefix_length(len(s), 80, 100))] >> np.uint64(58)).astype(np.uint8).tobytes(), at) for s, o, at in ((a, x, i), (b, y, j))]
        if similar(a, b, 80, 100):
            assert may_be_similar(*sides, 80, 100)
        else:
            ruled_out += not may_be_similar(*sides, 80, 100)
    assert ruled_out > 20
