"""Improbable-feature digests of documents.

Every window of 64 bytes has an entropy. Windows whose entropy level is rare over all documents rank first; a window that
ranks first in enough neighbourhoods of 64 windows is a feature. Features go in order into Bloom filters of 2048 bits, a new
one after every 160. Short texts have features of 16 bytes besides, chosen alike. Two digests are as alike as the bits of their filters overlap beyond chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, sum_arrays

WINDOW = 64
PAD = 2 * WINDOW
POPULAR = 16
#: Texts of fewer bytes also have features of SHORT_WINDOW bytes.
SHORT, SHORT_WINDOW = 1024, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
LEVELS = 1000
#: Windows of a lower entropy level (of 1000) say nothing and are never features.
TRIVIAL = 100
GROUP_BYTES = 1 << 19
MOST_RANGES = 1 << 16

_SCALE = 1 << 20
_C = np.arange(WINDOW + 1)
_G = np.rint(_C * np.log2(np.maximum(_C, 1)) * _SCALE).astype(np.int64)
_STEP = np.diff(_G)


def entropy_levels(buf: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy of each window of buf in thousandths of the largest."""
    n = len(buf)
    order = np.argsort(buf, kind="stable")
    key = (buf[order].astype(np.int64) << 40) | order
    lo = np.searchsorted(key, key - (window - 1))
    at = np.arange(n)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[order] = at - lo  # the byte's occurrences in the rest of a window before, and after
    after[order] = np.cumsum(np.bincount(lo, minlength=n)) - 1 - at
    first = _G[np.bincount(buf[:window], minlength=256)].sum()
    sums = np.empty(n - window + 1, np.int64)
    sums[0] = first
    sums[1:] = first + np.cumsum(_STEP[before[window:]] - _STEP[after[: n - window]])
    top = _G[window]
    return ((top - sums) * LEVELS // top).astype(np.int32)


def laid_out(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with padding around each, their starts, and which windows lie within a text."""
    starts, at = [], PAD
    for t in texts:
        starts.append(at)
        at += len(t) + PAD
    buf = np.zeros(at, np.uint8)
    inside = np.zeros(at - window + 1, bool)
    for s, t in zip(starts, texts, strict=True):
        buf[s : s + len(t)] = np.frombuffer(t, np.uint8)
        if len(t) >= window:
            inside[s : s + len(t) - window + 1] = True
    return buf, np.array(starts), inside


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t) + PAD
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Digester:
    """ranks: for each entropy level its place by rarity, rarest first."""

    def __init__(self, ranks: np.ndarray):
        self.ranks = ranks.astype(np.int64)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The chained filters of each text, 256 bytes each; nothing for an empty text."""
        return [x for group in groups(texts) for x in self._group(group)]

    def _group(self, texts: list[bytes]) -> list[bytes]:
        found = self._features(texts, WINDOW)
        short = [i for i, t in enumerate(texts) if len(t) < SHORT]
        if short:
            for i, own in zip(short, self._features([texts[i] for i in short], SHORT_WINDOW), strict=True):
                found[i] = np.concatenate([found[i], own])
        for i, t in enumerate(texts):
            if not len(found[i]) and t:  # too short or too plain for features: the whole text is the feature
                found[i] = np.frombuffer(hashlib.sha256(t).digest()[:8], "<u8")
        return [_chained(own) for own in found]

    def _features(self, texts: list[bytes], window: int) -> list[np.ndarray]:
        """Hashes of each text's windows that rank first in a quarter of their neighbourhoods."""
        buf, starts, inside = laid_out(texts, window)
        levels = entropy_levels(buf, window)
        worst = LEVELS + 2
        rank = np.where(inside & (levels >= TRIVIAL), self.ranks[levels], worst)
        width = max(20, int(len(buf)).bit_length())
        key = (rank << width) | np.arange(len(rank))
        if width <= 20:
            key = key.astype(np.int32)
        low, s = key, 1
        while s < window:
            low, s = np.minimum(low[:-s], low[s:]), 2 * s
        best = low & ((1 << width) - 1)
        popular = np.flatnonzero(np.bincount(best, minlength=len(rank)) >= POPULAR * window // WINDOW)
        popular = popular[rank[popular] < worst]
        windows = np.lib.stride_tricks.sliding_window_view(buf, window)[popular]
        hashes = _hashed(np.ascontiguousarray(windows).view("<u8"))
        edges = np.searchsorted(popular, [*starts, len(buf)])
        return [hashes[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _hashed(words: np.ndarray) -> np.ndarray:
    h = np.full(len(words), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _chained(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return b""
    bits = np.zeros((-(-len(hashes) // PER_FILTER), BITS), bool)
    row = np.arange(len(hashes)) // PER_FILTER
    for j in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """From 0 (no more than chance) to 1; the filters of the shorter chain count by their bits. Two empty digests are alike."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for d in sorted((a, b), key=lambda d: (len(d), d)))
    nx, ny = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance, most = nx * ny / BITS, np.minimum(nx, ny)
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float((score * nx[:, 0]).sum() / nx.sum())


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        for group in groups([x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]):
            buf, _, inside = laid_out(group)
            counts += np.bincount(entropy_levels(buf)[inside], minlength=LEVELS + 1)
    yield pa.record_batch({"slice": pa.array([0], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """Entropy levels by how few windows of all documents have them."""
    text = only(docs, "text")
    found = sum_arrays(text.mapInArrow(_level_counts, "slice int, part long, counts binary"), text.rdd.getNumPartitions())
    counts = found.get(0, np.zeros(LEVELS + 1, np.int64))
    return np.argsort(np.argsort(counts, kind="stable"), kind="stable")


def _ranged(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """docs with `bucket`, a range of doc_id in ascending order (null first), and the ranges that have rows."""
    from pyspark.ml.feature import Bucketizer

    n_bytes = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(min(MOST_RANGES, max(256, n_bytes >> 17), 1 + docs.count() // 4))
    points = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(p) for p in points}), float("inf")]
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    placed = Bucketizer(splits=splits, inputCol="key", outputCol="bucket").transform(keyed).drop("key").withColumn("bucket", F.col("bucket").cast("int"))
    return placed, splits


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) dealt and sorted so that in every bucket each row is followed by the next document of the whole
    table by descending doc_id (the first after the last). The last row of a bucket is a guest: the document that comes next elsewhere.

    Documents with one doc_id come by their text; those without a doc_id come last.
    """
    docs, _ = _ranged(only(docs, "doc_id", "text"))
    found = {r["bucket"]: r["head"] for r in docs.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # at most MOST_RANGES rows
    held = sorted(found)
    spark = docs.sparkSession
    to = spark.createDataFrame([(b, held[(i + 1) % len(held)]) for i, b in enumerate(held)], "bucket int, host int")
    head = spark.createDataFrame([(b, h) for b, h in found.items()], "bucket int, head long")
    lead = F.broadcast(head.join(to, "bucket").select(F.col("bucket").alias("from"), "head", "host"))
    heads = docs.join(lead, (docs["bucket"] == lead["from"]) & docs["doc_id"].eqNullSafe(lead["head"]))
    first = heads.groupBy("host").agg(F.min(F.struct("text")).alias("first"), F.max("doc_id").alias("doc_id"))  # one row, however often its id occurs
    guests = first.select(F.col("host").alias("bucket"), F.lit(1).alias("guest"), "doc_id", F.col("first.text").alias("text"))
    rows = docs.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last = Digester(ranks), None
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            own = digest([t.encode() for t in texts])
            rows, edits = [], []
            for bucket, guest, doc_id, text, fp in zip(batch["bucket"].to_pylist(), batch["guest"].to_pylist(), batch["doc_id"].to_pylist(), texts, own, strict=True):
                if last is not None and last[0] == bucket and not last[1]:
                    half = len(last[3]) // 2
                    rows.append((last[2], last[3], last[4], fp))
                    edits.append((last[3][: len(last[3]) - half] + text[:half]).encode())
                last = (bucket, guest, doc_id, text, fp)
            cut = digest(edits)
            yield pa.record_batch({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                "fingerprint": pa.array([r[2].hex() for r in rows], pa.string()),
                "edited_fingerprint": pa.array([e.hex() for e in cut], pa.string()),
                "near_edited": pa.array([likeness(r[2], e) for r, e in zip(rows, cut, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(r[2], r[3]) for r in rows], pa.float64()),
            })

    return run


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """One row per input row: its digest, that of its edited text, and its likeness to that and to the next document's digest.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document by descending doc_id.
    Null texts count as empty and have an empty digest, which is like another empty one (1) and nothing else (0). Texts without features have
    their whole as one. Equal texts have equal digests. A single document is its own next. Extra columns are ignored; an empty table gives an empty result.
    """
    docs = only(docs, "doc_id", "text")
    if not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], OUT)
    return with_next(docs).mapInArrow(_compared(rarity_ranks(docs)), OUT)


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint (binary) of every row. Digests compare only under the same ranks."""
    docs = only(docs, "doc_id", "text")
    ranks = rarity_ranks(docs) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digester(ranks)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "fingerprint": pa.array(digest([x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]), pa.binary())})

    return docs.mapInArrow(run, "doc_id long, fingerprint binary")
