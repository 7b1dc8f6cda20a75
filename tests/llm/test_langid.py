import random
import zlib

from pyspark.sql import functions as F

from contentprint.llm.langid import Model, Settings, _temperature, features, identify

WORDS = {"en": "the and of to thing water house running".split(), "de": "der und die zu ding wasser straße laufen".split(), "fr": "le et de la chose eau maison été".split()}


def rows(n=240):
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(6, 40))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_odd_rows(docs):
    data = rows()
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !!", None), (None, data[0][1], data[0][2]), (903, "the " * 30_000, None), data[0]]
    df = docs([*data, *odd]).withColumn("SCORE", F.lit("x"))
    out = identify(df, Settings(train_docs=150, calibration_docs=40)).collect()
    assert len(out) == len(data) + len(odd)
    got = {r.doc_id: r for r in out}
    for i, _, _ in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].lang_pred == lang) for i, _, lang in data if got[i].held_out]
    assert sum(held) >= 0.95 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and 0 <= got[903].score <= 1


def test_held_out_labels_are_not_used(docs):
    data = rows(80)
    def swap(r):
        return (r[0], r[1], "xx") if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r
    a, b = (sorted(map(tuple, identify(docs(x)).collect())) for x in (data, [swap(r) for r in data]))
    assert a == b


def test_nothing_to_learn_from(docs):
    assert identify(docs([])).count() == 0
    assert {(r.lang_pred, r.score) for r in identify(docs([(0, "abc", None)])).collect()} == {("und", 0.0)}


def test_features_count_every_gram():
    s = Settings(longest=2)
    at, n = features("Ab, ab", s)
    assert n.sum() == 7 + 6  # " ab ab " and its pairs
    assert not len(features("1 2", s)[0])


def test_temperature_softens_overconfidence():
    import numpy as np

    scored = [(0, np.array([9.0, 0.0]))] * 7 + [(1, np.array([9.0, 0.0]))] * 3
    assert _temperature(scored) > 5


def test_a_small_sample_without_errors_leaves_doubt():
    import numpy as np

    scored = [(i % 2, np.array([4.0, -4.0]) * (1 - 2 * (i % 2))) for i in range(60)]
    t = _temperature(scored)
    assert t > 0.06 and 0.9 < 1 / (1 + np.exp(-8 / t)) < 0.999


def test_ties_go_to_the_first_language_and_rare_labels_are_bounded(docs):
    import numpy as np

    s = Settings()
    model = Model(["aa", "bb"], np.ones(s.slots), np.zeros((s.slots + 1, 2)), 1.0, s)
    assert model.predict("some text") == ("aa", 0.5)
    data = [*rows(60), (500, "odd label here", "xx")]
    assert {r.lang_pred for r in identify(docs(data), Settings(languages=3)).collect()} <= set(WORDS)
