"""Exact line dedup over documents through a sharded minimal perfect hash.

Keys of distinct lines are counted with map-side combining. A shard is a bounded range of hashed keys; one task builds its minimal perfect
hash and the fingerprint, count and owner arrays that it indexes, and they go to the shared folder. A document's lines are dealt to the tasks
that hold their shards and probe the arrays there; a shard that very many lines ask for is held by several tasks. What goes back is a short
list for each document that loses lines. Lines are never joined with lines, and this is the only path, whatever the size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, is_unique, only, parts, tidy

BLANKS = b" \t\n\x0b\x0c\r"
#: A null doc_id counts as one document that comes before all others.
NULL_ID = -(2**63)
#: Shards up to which the table of their numbers of copies is broadcast (about 16 MB).
MOST_BROADCAST_SHARDS = 1_000_000


# ---------------------------------------------------------------- minimal perfect hash

def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bitmaps: a key takes the first level at which its slot is its own; its index is that bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) - bits + before
            self.ranks.append(rank)
            before += int(bits.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """keys: distinct uint64."""
        left, levels = keys, []
        while len(left):
            m = max(8, int(gamma * len(left)))
            slot = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            bits = np.bincount(slot, minlength=m) == 1
            levels.append(bits)
            left = left[~bits[slot]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for keys that surely weren't built in; other strangers get any index."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            slot = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[slot]
            out[open_[hit]] = self.ranks[level][slot[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join([len(self.levels).to_bytes(4, "little"), *(len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels)])

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        at, levels = 4, []
        for _ in range(int.from_bytes(blob[:4], "little")):
            m = int.from_bytes(blob[at : at + 8], "little")
            n = (m + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, n, at + 8), count=m).astype(bool))
            at += 8 + n
        return cls(levels)


ARRAYS = (("fingerprints", np.uint64), ("counts", np.uint32), ("owners", np.int64))


class Shard:
    """Arrays indexed by the perfect hash: the other half of the line hash, documents, owner; and apart, as `extra`, lines whose first half another line has."""

    def __init__(self, blob: dict):
        self.hash = PerfectHash.load(blob["hash"])
        for name, kind in ARRAYS:
            setattr(self, name, np.frombuffer(blob[name], kind))
        self.extra = {(a, b): (n, owner) for a, b, n, owner in np.frombuffer(blob["extra"], np.int64).reshape(-1, 4).tolist()}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of documents, owner) of each line hash, (0, NULL_ID) for lines that aren't in."""
        at = self.hash.index(h1)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == h2[known]
        counts, owners = np.zeros(len(h1), np.int64), np.full(len(h1), NULL_ID, np.int64)
        counts[known], owners[known] = self.counts[at[known]], self.owners[at[known]]
        if self.extra:
            for i in np.flatnonzero(~known).tolist():
                counts[i], owners[i] = self.extra.get((int(h1[i].view(np.int64)), int(h2[i].view(np.int64))), (0, NULL_ID))
        return counts, owners


SHARD_SCHEMA = "shard long, hash binary, fingerprints binary, counts binary, owners binary, extra binary"


def _build_shard(table: pa.Table) -> pa.Table:
    columns = [table[c].to_numpy().astype(np.int64) for c in ("h1", "h2", "n", "owner")]
    order = np.lexsort(columns[1::-1])
    h1, h2, n, owner = (x[order] for x in columns)
    first = np.concatenate([[True], h1[1:] != h1[:-1]])
    perfect = PerfectHash.build(h1[first].view(np.uint64))
    at = perfect.index(h1[first].view(np.uint64))
    out = {"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "hash": pa.array([perfect.dump()], pa.binary())}
    for (name, kind), values in zip(ARRAYS, (h2.view(np.uint64), np.minimum(n, 2**32 - 1), owner), strict=True):
        array = np.zeros(perfect.size, kind)
        array[at] = values[first]
        out[name] = pa.array([array.tobytes()], pa.binary())
    out["extra"] = pa.array([np.stack([x[~first] for x in (h1, h2, n, owner)], axis=1).tobytes()], pa.binary())
    return pa.table(out)


# ---------------------------------------------------------------- lines

def line_key(line: bytes) -> bytes:
    """Blanks at both ends go, A-Z become lower case."""
    return line.strip(BLANKS).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _line_hashes(least: int):
    """A row for each distinct long key of each document; `at` counts them from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            keys: list[bytes] = []
            sizes = []
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                own = dict.fromkeys(k for k in map(line_key, (raw or b"").split(b"\n")) if _long(k, least))
                keys += own
                sizes.append(len(own))
            h1, h2 = _hashes(keys)
            sizes = np.array(sizes)
            ids = batch["doc_id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            at = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch({"h1": h1, "h2": h2, "doc_id": np.repeat(ids, sizes), "text_key": np.repeat(batch["text_key"].to_numpy(), sizes), "at": at.astype(np.int32)})

    return run


def line_counts(lines: DataFrame, unique: bool) -> DataFrame:
    """(h1, h2, n, owner, load): documents and rows of each distinct key, and its largest doc_id."""
    if unique:
        return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"), F.count(F.lit(1)).alias("load"))
    own = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("load"))
    return own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("owner"), F.sum("load").alias("load"))


ASKED = ("h1", "h2", "doc_id", "text_key", "at")


def _probe(min_docs: int):
    """Rows come by shard and part, the shard's arrays first, then the lines that ask for them; out come the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            blobs = np.flatnonzero(batch["kind"].to_numpy() == 0)
            for start, end in zip([-1, *blobs], [*blobs, batch.num_rows], strict=True):
                if start >= 0:
                    shard = Shard(batch.slice(start, 1).to_pylist()[0])
                if end > start + 1:
                    h1, h2, ids, keys, at = (batch[c].slice(start + 1, end - start - 1).to_numpy() for c in ASKED)
                    counts, owners = shard.probe(h1.view(np.uint64), h2.view(np.uint64))
                    gone = (counts >= min_docs) & (owners != ids)
                    yield pa.record_batch({"doc_id": ids[gone], "text_key": keys[gone], "at": at[gone]})

    return run


def marks(lines: DataFrame, unique: bool, min_docs: int, shard_lines: int) -> DataFrame:
    """(doc_id, text_key, gone): which of its distinct keys a text loses."""
    counted = cut(line_counts(lines, unique))
    n = max(1, math.ceil(counted.count() / shard_lines))
    # h1 is hashed, so that shards are even; only the lines that ask for one may be many
    counted, lines = (x.withColumn("shard", F.pmod("h1", F.lit(n)).cast("long")) for x in (counted, lines))
    shards = cut(counted.groupBy("shard").applyInArrow(_build_shard, SHARD_SCHEMA))
    held = counted.groupBy("shard").agg((1 + F.floor(F.sum("load") / (2 * shard_lines))).cast("int").alias("copies"))
    held = F.broadcast(held) if n <= MOST_BROADCAST_SHARDS else held
    names = SHARD_SCHEMA.replace(" binary", "").split(", ")[1:]
    arrays = shards.join(held, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("kind"), *[F.lit(0).cast("int" if c == "at" else "long").alias(c) for c in ASKED], *names)
    asked = lines.join(held, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "text_key"), "copies").cast("int").alias("part"), F.lit(1).alias("kind"), *ASKED, *[F.lit(None).cast("binary").alias(c) for c in names])
    dealt = arrays.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    gone = dealt.mapInArrow(_probe(min_docs), "doc_id long, text_key long, at int")
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("gone"))


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            kept, n_lines, n_dropped = [], [], []
            for raw, gone in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["gone"].to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                left = lines
                if gone:
                    keys = [k if _long(k := line_key(line), least) else None for line in lines]
                    own = list(dict.fromkeys(k for k in keys if k is not None))
                    lost = {own[i] for i in gone}
                    left = [line for line, k in zip(lines, keys, strict=True) if k is None or k not in lost]
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), **{c: batch[c] for c in batch.schema.names if c not in ("doc_id", "text", "gone")}})

    return run


@tidy
def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = 16 << 20, shard_lines: int = 1 << 15, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text without its dropped lines), and the columns in `keep`.

    A text is split at \\n; null or empty is one empty line. A line's key is the line without blanks at its ends, A-Z
    lower-cased. Keys of at least min_chars code points found in at least min_docs different documents lose their lines in
    all documents but the one with the largest doc_id, which keeps all of them. Rows with one doc_id (or with none, which
    sorts first) count as one document. Repeated rows are repeated. An empty table gives an empty result. Extra columns are ignored.
    broadcast_bytes: size of the list of lost lines up to which it is sent to the texts; beyond, both are joined by a shuffle.
    """
    docs = only(docs, "doc_id", "text", *keep)
    types = dict(docs.dtypes)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    lines = cut(own.mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc_id long, text_key long, at int"))
    lost = cut(marks(lines, is_unique(docs, "doc_id"), min_docs, shard_lines).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"), "gone"))
    size = lost.agg(F.sum(48 + 4 * F.size("gone"))).first()[0] or 0
    same = (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("lost_id")) & (F.xxhash64("text") == F.col("lost_key"))
    joined = docs.join(F.broadcast(lost) if size <= broadcast_bytes else lost, same, "left").select("doc_id", "text", "gone", *keep)
    schema = "doc_id long, n_lines long, n_dropped long, kept string" + "".join(f", `{c}` {types[c]}" for c in keep)
    return joined.mapInArrow(_drop(min_chars), schema)
