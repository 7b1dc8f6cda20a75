"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from all training documents. The classifier is fitted on a bounded sample of them, spread over the languages,
by follow-the-regularised-leader with an elastic-net penalty; a second bounded sample sets the softmax temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, parts, sum_arrays

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """train_docs, calibration_docs: bounds of the labelled samples. languages: the most frequent labels that are told apart, a bound of the
    classifier's size. slots: hashed n-grams. The rest belongs to the fit."""

    train_docs: int = 6000
    calibration_docs: int = 1500
    languages: int = 1000
    slots: int = 1 << 15
    longest: int = 3
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01


class Letters:
    """Code points of a text as the classifier sees them: lower case, everything between letters as one blank."""

    def __init__(self):
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
        letter = self.is_letter[codes]
        kept = letter.copy()
        kept[0] = True
        kept[1:] |= letter[:-1]
        return np.where(letter, codes, 32)[kept].astype(np.uint32)


_LETTERS: list[Letters] = []


def features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's n-grams, ascending, and their counts; none for a text without letters."""
    if not _LETTERS:
        _LETTERS.append(Letters())
    codes = _LETTERS[0](text or "")
    if not (codes != 32).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    counts = np.zeros(s.slots, np.int64)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, min(s.longest, len(codes)) + 1):
        gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        x = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35 + 2 * n)
        counts += np.bincount((x >> np.uint32(16)) & np.uint32(s.slots - 1), minlength=s.slots)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


class FTRL:
    """Per-coordinate follow-the-regularised-leader for a softmax; the weights are sparse through the L1 part."""

    def __init__(self, n_classes: int, s: Settings):
        self.s = s
        self.z, self.n = np.zeros((s.slots + 1, n_classes)), np.zeros((s.slots + 1, n_classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        return np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, self.s.slots), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text, self.settings)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weigh(at, counts, self.idf) @ self.weights[at] + self.weights[-1]


def _frequencies(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(s.slots, np.int64)
        for batch in parts(batches, "text"):
            for text in batch["text"].to_pylist():
                df[features(text, s)[0]] += 1
        yield pa.record_batch({"slice": pa.array([0], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "counts": pa.array([df.tobytes()], pa.binary())})

    return run


def _samples(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            both = [features(text, s) for text in batch["text"].to_pylist()]
            yield pa.record_batch({"lang": batch["lang"], "draw": batch["draw"], "at": pa.array([a.astype("<u4").tobytes() for a, _ in both], pa.binary()), "n": pa.array([b.astype("<u4").tobytes() for _, b in both], pa.binary())})

    return run


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """labelled: doc_id, text, lang (not null). Samples are drawn by a hash of the id, each language alike."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(s.slots), np.zeros((s.slots + 1, 0)), 1.0, s)
    n_docs = sum(sizes.values())
    df = sum_arrays(labelled.select("text").mapInArrow(_frequencies(s), "slice int, part long, counts binary"), labelled.rdd.getNumPartitions())
    idf = np.log((1 + n_docs) / (1 + df.get(0, np.zeros(s.slots)))) + 1

    wanted = s.train_docs + s.calibration_docs
    share = {lang: min(1.0, wanted / len(languages) / n) for lang, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) / 1e6
    quota = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]  # null, which draws nothing, for other labels
    drawn = labelled.withColumn("draw", draw / quota).filter("draw < 1").select("text", "lang", "draw")
    rows = drawn.mapInArrow(_samples(s), "lang string, draw double, at binary, n binary").orderBy("draw").limit(2 * wanted).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["at"]))
    data = [(languages.index(r["lang"]), np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in rows if r["at"]]
    held = len(data) * s.calibration_docs // wanted
    fit = FTRL(len(languages), s)
    rng = np.random.default_rng(5)
    for _ in range(s.epochs):
        for i in rng.permutation(len(data) - held) + held:
            label, at, counts = data[i]
            fit.learn(at, weigh(at, counts, idf), label)
    model = Model(languages, idf, fit.weights(), 1.0, s)
    model.temperature = _temperature([(y, model.logits(at, counts)) for y, at, counts in data[:held]])
    return model


def _temperature(scored: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of the least log loss, between 1/20 and 20. Targets are smoothed by what one more wrong document in each language would
    add, so that a small sample without errors doesn't make every score a one."""
    if not scored:
        return 1.0
    y, z = np.array([a for a, _ in scored]), np.array([b for _, b in scored])
    n, k = z.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)

    def loss(log_t: float) -> float:
        x = z / np.exp(log_t)
        m = x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x - m).sum(axis=1)) + m[:, 0] - (target * x).sum(axis=1)).mean())

    lo, hi, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with lang_pred and score put after them; clashing names of docs go first."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in parts(batches, "text"):
            found = [own.predict(text) for text in batch["text"].to_pylist()]
            yield pa.record_batch({**{c: batch[c] for c in names}, "lang_pred": pa.array([a for a, _ in found], pa.string()), "score": pa.array([b for _, b in found], pa.float64())})

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double")


def held_out() -> F.Column:
    """True for documents that must not be learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred).

    Learns from text and non-null lang of the rows that aren't held out, and predicts from whole texts alone. Null texts and texts without
    letters are `und` with score 0, and so is everything where nothing can be learnt from. Ties go to the language that sorts first.
    Repeated rows count repeatedly. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.filter("NOT held_out AND lang IS NOT NULL").select("doc_id", "text", "lang"), s)
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
