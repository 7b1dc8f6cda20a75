import random
import re

from pyspark.sql import functions as F

from contentprint.llm.decontaminate import candidates, block_index, contaminations, decontaminate

BENCH = "item_id long, text string"


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def weight(s):
    return sum(1 + sum(len(w) >= 6 for w in x) for x in s)


def brute(rows, bench, similarity=80):
    best = {}
    for i, t in bench:
        n, own = len(words(t)), set(shingles(words(t)))
        for d, text in rows:
            sh = shingles(words(text))
            for start in range(max(1, len(sh) - (n - 4) + 1)) if own else ():
                w = set(sh[start : start + n - 4])
                common, every = weight(w & own), weight(w | own)
                if common and common * 100 >= every * similarity:
                    key = (common / every, -start)
                    best[d, i] = max(best.get((d, i), key), key)
    return sorted(((d, i, -b, round(s, 9)) for (d, i), (s, b) in best.items()), key=str)


def sample():
    rng = random.Random(4)
    vocabulary = [f"{c}word{'long' * (c % 3)}" for c in range(300)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 40)))) for i in range(15)]
    rows = []
    for d in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(400))]
        item = words(rng.choice(bench)[1])
        if d % 3:
            if d % 5 == 0:
                item[rng.choice([0, 1, -1, -2])] = "changed"
            if d % 7 == 0:
                item = item[: len(item) - 2]
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        rows.append((d, rng.choice([" ", "\n", ", "]).join(w).upper() if d % 2 else " ".join(w)))
    long_ = " ".join(rng.choice(vocabulary) for _ in range(3000))
    return [*rows, (100, None), (101, ""), (102, "four words only here"), (103, f"{long_} {bench[3][1]} {long_}"), (1, rows[1][1]), (1, bench[0][1]), (104, bench[2][1] * 1), (105, (bench[2][1] + " ") * 30)], [*bench, (50, None), (51, "too few words"), (52, bench[2][1])]


def test_equals_brute_force(spark, docs):
    rows, bench = sample()
    df, items = docs(rows).withColumn("Codes", F.lit(1)), spark.createDataFrame(bench, BENCH).withColumn("N", F.lit(0))
    want = brute(rows, bench)
    for most in (1_000_000, 0):
        got = [(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in contaminations(df, items, broadcast_rows=most).collect()]
        assert sorted(got, key=str) == want
    kept = {r.doc_id for r in decontaminate(df, items).collect()}
    assert kept == {d for d, _ in rows} - {d for d, *_ in want}


def test_a_very_long_item_and_rows_of_one_id(spark, docs):
    """An item of 3 000 words beside short ones; a row with the same id, and one without, are judged by their own texts."""
    rng = random.Random(12)
    vocabulary = [f"{c}word{'long' * (c % 3)}" for c in range(400)]
    long_ = [rng.choice(vocabulary) for _ in range(3000)]
    other = [rng.choice(vocabulary) for _ in range(700)]
    rows = [(1, " ".join(other + long_ + other)), (1, " ".join(other)), (2, " ".join(long_[:2000])), (3, " ".join(long_[40:])), (None, " ".join(other[:30])), (None, "quite another text than that")]
    bench = [(0, " ".join(long_)), (1, " ".join(other[:30]))]
    items = spark.createDataFrame(bench, BENCH)
    found = {(r.doc_id, r.item_id): (r.n_words, r.start_word) for r in contaminations(docs(rows), items).collect()}
    assert found == {(1, 0): (3000, 700), (1, 1): (30, 0), (3, 0): (3000, 0), (None, 1): (30, 0)}
    kept = decontaminate(docs(rows).withColumn("DOC_ID2", F.lit(1)), items).collect()
    assert sorted((str(r.doc_id), len(r.text)) for r in kept) == sorted([("2", len(rows[2][1])), ("None", len(rows[5][1]))])


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], BENCH)
    assert contaminations(docs([(1, "a b c d e f")]), none).count() == 0
    assert contaminations(docs([]), spark.createDataFrame([(1, "a b c d e f")], BENCH)).count() == 0
    assert decontaminate(docs([(None, "a b c d e f"), (2, "x")]), spark.createDataFrame([(1, "a b c d e f")], BENCH)).count() == 1


def test_blocks_find_everything_within_the_radius(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(6)]
    near = []
    for i in range(200):
        fp = rng.choice(fps)
        for bit in rng.sample(range(63), rng.randrange(0, 24)):
            fp ^= 1 << bit
        near.append((i, 7, fp))
    items = spark.createDataFrame([(i, 7, f) for i, f in enumerate(fps)], "item long, n int, item_fp long")
    windows = spark.createDataFrame(near, "window long, n int, fp long")
    got = sorted((r.window, r.item, r.distance) for r in candidates(windows, block_index(items, 19, 5), 19, 5).collect())
    assert got == sorted((w, i, (f ^ g).bit_count()) for w, _, f in near for i, g in enumerate(fps) if (f ^ g).bit_count() <= 19)
