"""Co-training of a quality classifier on two views of a document.

The text view sees what is written (hashed words and surface ratios); the metadata view sees where it comes from and how large it is. Each is fitted on a
bounded sample of labelled documents. In every round each view scores all unlabelled documents on the executors and names those that it is surest of, and the
other learns them with these labels. Held-out labelled documents calibrate each view and weigh the two; the result scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, parts, tidy


@dataclass(frozen=True)
class Settings:
    """labelled_docs, and per_round for a round, view and label, bound what is fitted on. confident: least calibrated probability of a pseudo-label.

    pool_docs is accepted and not read: there is no pool, all unlabelled documents can get a pseudo-label.
    """

    labelled_docs: int = 6000
    pool_docs: int = 6000
    rounds: int = 4
    per_round: int = 400
    confident: float = 0.9
    slots: int = 1 << 13
    meta_slots: int = 1 << 10
    epochs: int = 12
    rate: float = 0.5
    l2: float = 1e-5


SYMBOLS = re.compile(r"[^\w\s.,;:'\"?!()\-–—’“”«»¿¡…]")
REMEMBERED = 500_000


class _Slots(dict):
    def __init__(self, slots: int):
        self.slots = slots

    def __missing__(self, key: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[key] = xxhash.xxh3_64_intdigest(key) % self.slots
        return value


def text_features(text: str | None, slots: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: log counts of words, scaled to length one, after eight ratios of the surface."""
    text = text or ""
    n = max(1, len(text))
    tokens = text.split()
    words = Counter(tokens)
    lines = text.split("\n")
    ratios = np.array([
        len(SYMBOLS.findall(text)) / n, sum(map(str.isupper, text)) / n, sum(map(str.isdigit, text)) / n, text.count("!") / n,
        len(words) / max(1, len(tokens)), len(set(lines)) / len(lines), min(1.0, n / max(1, len(tokens)) / 20), max(words.values(), default=0) / max(1, len(tokens)),
    ])
    own: dict[int, float] = {}
    for word, count in words.items():
        at = slots[word.lower()] + len(ratios) + 8
        own[at] = own.get(at, 0) + count
    at = np.fromiter(own.keys(), np.int64, len(own))
    x = 1 + np.log(np.fromiter(own.values(), np.float64, len(own)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    return np.concatenate([np.arange(len(ratios)), at]), np.concatenate([4 * ratios, x])


def meta_features(lang: str | None, source: str | None, n_chars: int | None, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Language, source and size class, each alone and in pairs."""
    size = "none" if n_chars is None or n_chars <= 0 else str(int(np.log2(n_chars)))
    names = [f"l{lang}", f"s{source}", f"n{size}", f"l{lang}n{size}", f"l{lang}s{source}"]
    at = sorted({xxhash.xxh3_64_intdigest(x) % slots for x in names})
    return np.array(at), np.ones(len(at))


class View:
    """A logistic regression with adaptive rates, and its Platt scaling."""

    def __init__(self, width: int, s: Settings):
        self.w, self.a, self.b, self.s = np.zeros(width + 1), 1.0, 0.0, s

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(self.w[at] @ x + self.w[-1])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        return self.a * self.raw(at, x) + self.b

    def fit(self, rows: list, labels: list[int]) -> None:
        self.w[:] = 0
        total = np.full(len(self.w), 1e-6)
        share = min(0.95, max(0.05, float(np.mean(labels)))) if labels else 0.5
        weigh = (0.5 / (1 - share), 0.5 / share)
        rng = np.random.default_rng(11)
        for _ in range(self.s.epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                at, x = np.append(at, len(self.w) - 1), np.append(x, 1.0)
                g = weigh[labels[i]] * (sigmoid(self.w[at] @ x) - labels[i]) * x + self.s.l2 * self.w[at]
                total[at] += g * g
                self.w[at] -= self.s.rate * g / np.sqrt(total[at])

    def calibrate(self, rows: list, labels: list[int]) -> float:
        """Platt scaling by Newton steps; returns the log loss that is left."""
        self.a, self.b = 1.0, 0.0
        if not rows:
            return 1.0
        z, y = np.array([self.raw(*r) for r in rows]), np.array(labels, float)
        n1, n0 = y.sum(), len(y) - y.sum()
        soft = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(60):
            p = sigmoid(self.a * z + self.b)
            w = p * (1 - p) + 1e-9
            g = np.array([((p - soft) * z).sum() + 1e-3 * self.a, (p - soft).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            self.a, self.b = self.a - np.clip(step[0], -2, 2), self.b - np.clip(step[1], -2, 2)
        p = np.clip(sigmoid(self.a * z + self.b), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    text: View
    meta: View
    shares: tuple[float, float]
    settings: Settings
    #: Log losses of the two views on held-out labels before the first exchange and after each one.
    history: list[tuple[float, float]]


def _unpacked(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind)


def _raw(w: np.ndarray, at: list[bytes], x: list[bytes] | None = None) -> np.ndarray:
    """What View.raw gives, for packed rows; each has a feature at least."""
    terms = w[_unpacked(at, "<u4")]
    if x is not None:
        terms = terms * _unpacked(x, "<f4")
    return np.add.reduceat(terms, np.cumsum([0, *(len(a) // 4 for a in at[:-1])])) + w[-1]


def _margins(views: list[View], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the two views for rows of features()."""
    raws = _raw(views[0].w, batch["at"].to_pylist(), batch["x"].to_pylist()), _raw(views[1].w, batch["meta"].to_pylist())
    return tuple(v.a * r + v.b for v, r in zip(views, raws, strict=True))


FEATURES = "doc_id long, key long, at binary, x binary, meta binary"


def features(docs: DataFrame, s: Settings) -> DataFrame:
    """One row per document: doc_id, key (a hash of the row), and packed the slots and values of the text view and the slots of the metadata view."""
    keyed = docs.select("doc_id", F.xxhash64(F.lit(29), "doc_id", "text", "lang", "source", "n_chars").alias("key"), "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(s.slots)
        for batch in parts(batches, "text"):
            both = [text_features(x, slots) for x in batch["text"].to_pylist()]
            meta = [meta_features(*row, s.meta_slots)[0] for row in zip(*[batch[c].to_pylist() for c in ("lang", "source", "n_chars")], strict=True)]
            own = ("at", [a.astype("<u4").tobytes() for a, _ in both]), ("x", [x.astype("<f4").tobytes() for _, x in both]), ("meta", [m.astype("<u4").tobytes() for m in meta])
            yield pa.record_batch({"doc_id": batch["doc_id"], "key": batch["key"], **{name: pa.array(rows, pa.binary()) for name, rows in own}})

    return keyed.mapInArrow(run, FEATURES)


def _pair(r) -> tuple:
    meta = np.frombuffer(r["meta"], "<u4").astype(np.int64)
    return (np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)), (meta, np.ones(len(meta)))


def _labelled(made: DataFrame, known: DataFrame, s: Settings) -> list:
    """(quality, features of the two views): at most the bounded number of labelled documents, drawn by a hash of the id."""
    ids = made.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(known, "doc_id")
    drawn = ids.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(s.labelled_docs).collect()
    wanted = made.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in drawn], "doc_id long, quality int")
    rows = made.join(F.broadcast(wanted), "doc_id")  # the bound above is the bound of this side
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("key", "at", "x", "meta")).alias("row"))  # of rows with one id that with the least key
    return [(r["quality"], *_pair(r["row"])) for r in sorted(one.collect(), key=lambda r: r["doc_id"])]


def _sure(made: DataFrame, known: DataFrame, views: list[View], taught: list[dict], s: Settings, prior: float = 0.5) -> list[dict]:
    """For each view the documents it is surest of, {ident: (label, features)}: of all unlabelled ones, per_round at most a label, less those the other view has.

    prior: the share of quality 1 among the labelled documents. Beside being `confident`, a view must find the label likelier than that share makes it:
    a view that knows nothing would else teach the base rate. Equally sure ones go by a hash of the row, so that no source is preferred. ident: doc_id, or key where that is null.
    """
    sent = made.sparkSession.sparkContext.broadcast((views, s.confident))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = sent.value
        for batch in parts(batches, "x"):
            p = [np.round(sigmoid(m), 12) for m in _margins(own, batch)]
            hit = pa.array(np.any([(x >= least) & (x > prior) | (1 - x >= least) & (x < prior) for x in p], axis=0))
            yield pa.record_batch({"doc_id": batch["doc_id"], "key": batch["key"], "p0": pa.array(p[0]), "p1": pa.array(p[1])}).filter(hit)

    found = made.mapInArrow(run, "doc_id long, key long, p0 double, p1 double").join(known.select("doc_id"), "doc_id", "left_anti")
    scored = cut(found.select(F.coalesce("doc_id", "key").alias("ident"), "key", "p0", "p1"))
    picks = []  # (view, label, ident, key)
    for v in (0, 1):
        used = made.sparkSession.createDataFrame([(i,) for i in taught[1 - v]], "ident long")
        fresh = scored.join(F.broadcast(used), "ident", "left_anti")
        for y, sure in ((1, F.col(f"p{v}")), (0, 1 - F.col(f"p{v}"))):
            best = fresh.select("ident", "key", sure.alias("sure")).filter((F.col("sure") >= s.confident) & (F.col("sure") > (prior if y else 1 - prior)))
            best = best.groupBy("ident").agg(F.max(F.struct("sure", "key")).alias("b")).orderBy(F.desc("b"), "ident").limit(s.per_round)
            picks += [(v, y, r["ident"], r["b"]["key"]) for r in best.collect()]
    wanted = made.sparkSession.createDataFrame([(k,) for k in {p[3] for p in picks}], "key long")
    rows = {r["key"]: _pair(r) for r in made.join(F.broadcast(wanted), "key").dropDuplicates(["key"]).collect()}
    return [{i: (y, rows[k]) for w, y, i, k in picks if w == v} for v in (0, 1)]


def train(made: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model of features() and labels; None if there isn't a document of either label."""
    judged = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = _labelled(made, judged, s)
    rng = np.random.default_rng(3)
    order = rng.permutation(len(labelled))
    held, known = [labelled[i] for i in order[: len(order) // 5]], [labelled[i] for i in order[len(order) // 5 :]]
    if len({d[0] for d in known}) < 2:
        return None
    views = [View(s.slots + 16, s), View(s.meta_slots, s)]
    taught: list[dict] = [{}, {}]  # ident: (label, features) that the other view gave
    losses, history, best = [1.0, 1.0], [], {}
    prior = float(np.mean([d[0] for d in known]))
    for turn in range(s.rounds + 1):
        for v, view in enumerate(views):
            rows = [d[1 + v] for d in known] + [pair[v] for _, pair in taught[v].values()]
            view.fit(rows, [d[0] for d in known] + [y for y, _ in taught[v].values()])
            losses[v] = view.calibrate([d[1 + v] for d in held], [d[0] for d in held])
            if v not in best or losses[v] <= best[v][0]:
                best[v] = losses[v], view.w.copy(), view.a, view.b
        history.append(tuple(losses))
        if turn == s.rounds:
            break
        for v, own in enumerate(_sure(made, judged, views, taught, s, prior)):
            taught[1 - v] |= own
    for v, view in enumerate(views):  # an exchange that made a view worse on held-out labels isn't kept
        losses[v], view.w, view.a, view.b = best[v]
    trust = [max(1e-3, np.log(2) - x) for x in losses]  # what each view knows beyond a coin
    return Model(views[0], views[1], (trust[0] / sum(trust), trust[1] / sum(trust)), s, history)


@tidy
def score_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, score (probabilities of quality 1), quality_pred (score of a half or more).

    Labels other than 0 and 1 are ignored; of several labels of one document the largest holds. Without documents of both labels every score is a half.
    Null texts and metadata are values of their own. Rows with one doc_id are scored each. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs, labels = only(docs, "doc_id", "text", "lang", "source", "n_chars"), only(labels, "doc_id", "quality")
    made = cut(features(docs, s))
    sent = spark.sparkContext.broadcast(train(made, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in parts(batches, "x"):
            a, b = _margins([model.text, model.meta], batch) if model else np.zeros((2, batch.num_rows))
            both = model.shares[0] * a + model.shares[1] * b if model else a
            scores = [sigmoid(z) for z in (a, b, both)]
            yield pa.record_batch({"doc_id": batch["doc_id"], **{name: pa.array(x, pa.float64()) for name, x in zip(("text_score", "meta_score", "score"), scores, strict=True)}, "quality_pred": pa.array((scores[2] >= 0.5).astype(np.int32), pa.int32())})

    return made.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, quality_pred int")
