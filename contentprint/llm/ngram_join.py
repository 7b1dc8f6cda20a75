"""Exact Jaccard join of documents on word n-gram sets, and its connected components.

* Documents with one set become one class; its copies never meet each other.
* All n-grams have one global order, rare first: by the log of a counter (a table of hashed counts over all documents), then by hash.
  Similar sets must share one of their first n - ceil(t n) + 1 n-grams, so classes meet in buckets of those alone. Buckets that may be
  large are dealt to several tasks.
* Length and positional filters hold within a bucket. In a bucket each class first meets only the one whose common n-gram comes
  earliest; what is linked that way needs no further comparison. Then classes of one bucket that are still in different
  components meet, all of them, if the bucket is small. A larger one is split by the second shared n-gram, then by the third, and so on:
  sets that share l n-grams at least share l of their first n - ceil(t n) + l. So neither a large group of near copies nor an
  n-gram in all documents leads to all pairs, and no link between components is lost.
* A candidate pair passes the suffix filter on what follows its first shared n-gram, and is verified once by its exact intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, parts as slices, sum_arrays, tidy

#: Stands for a null doc_id.
NULL_ID = -(2**63)

SLICE = 1 << 16
#: Counters behind the order of n-grams. They are broadcast, one byte each; what they can't tell apart, the split of buckets does.
MOST_COUNTERS = 1 << 22
MOST_BLOOM_BITS = 1 << 26
REMEMBERED = 100_000
#: Classes of a bucket up to which all that are in different components meet at once; a larger bucket is split by a further n-gram. Groups of
#: some thousand near copies of which few link share most n-grams, so that a split takes rounds and rules nothing out: they stay below.
SMALL_BUCKET = 8192
#: n-grams counted this often and more (as logged by the counters) have their bucket dealt to SALTS tasks.
HOT_CODE, SALTS = 24, 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """The sorted distinct 64-bit hashes of a text's shingles of k words."""

    def __init__(self, k: int):
        self.k, self.ids = k, _WordIds()

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().split()  # on bytes: A-Z and the six ASCII blanks
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.ids.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total = total * _MULT + h[i : len(h) - k + 1 + i]
        return np.unique(_finish(total))


def _node(shingles: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _sketch(shingles: np.ndarray) -> bytes:
    """Sizes of 64 equal ranges of the hash space; what two of them differ by is a lower bound for the symmetric difference."""
    sizes = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=64)
    return sizes.astype("<u2" if len(shingles) < 1 << 16 else "<u4").tobytes()


def _sizes(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u2" if len(sketch) == 128 else "<u4").astype(np.int64)


FACTS = "doc_id long, key long, n long, node long, other long, sketch binary, slice int, part long, small binary"


def _facts(k: int, seed: int, bits: int):
    """A row for each document, and this task's counters, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, mask = Shingler(k), np.uint64((1 << bits) - 1)
        counts = np.zeros(1 << bits, np.int32)
        for batch in slices(batches, "text"):
            sizes, nodes, others, sketches, parts, held = [], [], [], [], [], 0
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                s = shingler(raw)
                parts.append(s)
                held += len(s)
                if held > 1 << 20:
                    _count(counts, parts, mask)
                    parts, held = [], 0
                sizes.append(len(s))
                nodes.append(_signed(_node(s, seed)) if len(s) else None)
                others.append(_signed(_node(s, seed + 1_000_003)) if len(s) else None)
                sketches.append(_sketch(s) if len(s) else None)
            _count(counts, parts, mask)
            none = len(sizes)
            yield pa.record_batch({"doc_id": batch["doc_id"], "key": batch["key"], "n": pa.array(sizes, pa.int64()), "node": pa.array(nodes, pa.int64()), "other": pa.array(others, pa.int64()), "sketch": pa.array(sketches, pa.binary()), "slice": pa.nulls(none, pa.int32()), "part": pa.nulls(none, pa.int64()), "small": pa.nulls(none, pa.binary())})
        part = TaskContext.get().partitionId()
        for i in range(0, 1 << bits, SLICE):
            if (own := counts[i : i + SLICE]).any():
                # a task's counts are cut to a byte each: the order stays one order for all documents
                small = np.minimum(own, 255).astype(np.uint8).tobytes()
                yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "key": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "node": pa.nulls(1, pa.int64()), "other": pa.nulls(1, pa.int64()), "sketch": pa.nulls(1, pa.binary()), "slice": pa.array([i // SLICE], pa.int32()), "part": pa.array([part], pa.int64()), "small": pa.array([small], pa.binary())})

    return run


def _count(counts: np.ndarray, parts: list[np.ndarray], mask: np.uint64) -> None:
    for s in parts:
        np.add.at(counts, (s & mask).astype(np.int64), 1)


def rarity(parts: DataFrame, n: int, bits: int) -> np.ndarray:
    """For each of 2^bits hash slots, a byte that grows with the number of shingles in it, over all documents. n: tasks that counted."""
    out = np.zeros(1 << bits, np.uint8)
    for i, own in sum_arrays(parts.withColumnRenamed("small", "counts"), n, code=lambda counts: np.floor(2 * np.log2(counts + 1)).astype(np.uint8), kind="u1").items():
        out[i * SLICE : i * SLICE + len(own)] = own
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n + num * n // -den + 1  # n - ceil(t n) + 1


def _prefixes(k: int, seed: int, num: int, den: int, sent, bits: int, hot_code: int):
    """A row for each n-gram of a class's prefix; the first one also has the hash ranges of them all, a byte each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, order, mask, seen = Shingler(k), np.frombuffer(sent.value, np.uint8), np.uint64((1 << bits) - 1), set()
        for batch in slices(batches, "text"):
            tokens, codes, nodes, sizes, lengths, heads = [], [], [], [], [], []
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                s = shingler(raw)
                if not len(s) or (node := _node(s, seed)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                n = len(s)
                p = prefix_length(n, num, den)
                code = order[(s & mask).astype(np.int64)]
                first = np.argsort(code, kind="stable")[:p]
                tokens.append(s[first])
                codes.append(code[first])
                nodes.append(node)
                sizes.append(n)
                lengths.append(p)
                heads.append((tokens[-1] >> np.uint64(58)).astype(np.uint8).tobytes())
            if tokens:
                reps = np.array(lengths)
                starts, total = np.cumsum(reps) - reps, int(reps.sum())
                which, absent = np.zeros(total, np.int32), np.ones(total, bool)
                which[starts], absent[starts] = np.arange(len(heads)), False
                yield pa.record_batch({
                    "token": np.concatenate(tokens).view(np.int64),
                    "node": np.repeat(np.array(nodes, np.uint64).view(np.int64), reps),
                    "n": np.repeat(np.array(sizes, np.int32), reps),
                    "pos": np.arange(total, dtype=np.int32) - np.repeat(starts, reps).astype(np.int32),
                    "hot": pa.array(np.concatenate(codes) >= hot_code),
                    "head": pa.array(heads, pa.binary()).take(pa.array(which, mask=absent)),
                })

    return run


def _further(k: int, seed: int, num: int, den: int, order_sent, bits: int, held_sent, size: int, more: int):
    """node and its first n-grams in order, `more` beyond the prefix, of the classes whose document may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, mask = np.frombuffer(order_sent.value, np.uint8), np.uint64((1 << bits) - 1)
        for nodes, sets in _wanted(batches, Shingler(k), seed, held_sent, size):
            own = [s[np.argsort(order[(s & mask).astype(np.int64)], kind="stable")[: prefix_length(len(s), num, den) + more]].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, own)])
            values = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))})

    return run


def _bloom(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _slots(batch["rep"].to_numpy().view(np.uint64), size):
                np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.record_batch({"held": pa.array([held.tobytes()], pa.binary())})

    return run


def _slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    mask, mixed = np.uint64(bits - 1), _finish(ids)
    return [(mixed & mask).astype(np.int64), ((mixed >> np.uint64(32)) & mask).astype(np.int64)]


def _wanted(batches: Iterator[pa.RecordBatch], shingler: Shingler, seed: int, sent, size: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Names and sets of documents that may be wanted: most others aren't even split."""
    held = np.frombuffer(sent.value, np.uint8)
    for batch in slices(batches, "text"):
        ids = batch["doc_id"].fill_null(NULL_ID).to_numpy(zero_copy_only=False).view(np.uint64)
        wanted = np.logical_and.reduce([held[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _slots(ids, size)]).astype(bool)
        sets = [s for raw in batch["text"].filter(pa.array(wanted)).cast(pa.binary()).to_pylist() if len(s := shingler(raw))]
        yield [_signed(_node(s, seed)) for s in sets], sets


def _sets(k: int, seed: int, sent, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _wanted(batches, Shingler(k), seed, sent, size):
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def suffix_sizes(sketch: bytes, head: bytes, at: int) -> np.ndarray:
    """How many n-grams after position `at` of the order lie in each hash range."""
    return _sizes(sketch) - np.bincount(np.frombuffer(head, np.uint8, at + 1), minlength=64)


def may_be_similar(a: tuple[int, bytes, bytes, int], b: tuple[int, bytes, bytes, int], num: int, den: int) -> bool:
    """The suffix filter on two sets (size, sketch, head, position of the first shared n-gram): False only if they can't be similar.

    Their suffixes differ by at least what the sizes of their hash ranges differ by, and must share all but one of the n-grams needed.
    """
    (n, x, p, i), (m, y, q, j) = a, b
    needed = -(-num * (n + m) // (num + den))
    apart = int(np.abs(suffix_sizes(x, p, i) - suffix_sizes(y, q, j)).sum())
    return apart <= (n - i - 1) + (m - j - 1) - 2 * (needed - 1)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b|, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _kept(columns: tuple[str, ...], good):
    """The pairs (a, b) for which good(*columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [good(*row) for row in zip(*[batch[c].to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _joined(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs with the other columns of (node, ..) for a and for b, as <column>_a and <column>_b."""
    for x in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in of.columns if c != "node"]), x)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the links (a, b). Each round hands every node to the least node next to it and contracts the graph.

    Ids are hashes, so that the number of rounds grows with the logarithm of the number of nodes. Links stay distributed.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        up = step.filter("node <> root")
        if roots is None:
            roots = step
        else:
            roots = cut(roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to"))
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"))
        edges = cut(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


@tidy
def link_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str | None = None, small_bucket: int = SMALL_BUCKET, hot_code: int = HOT_CODE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included). If a long column
    of docs is named as key, also group (a number of the component, null for rows without a set) and key, that column.

    Words are stretches of other characters than ASCII blanks, A-Z lower-cased; a document's set is that of its k-word
    shingles, all its words as one if it has fewer; null, empty and blank texts have no set and no link. Two documents link if
    den * intersection >= num * union. Rows that share a doc_id are documents of their own; a null doc_id counts only where
    no other is reachable. Repeated rows are repeated. Extra columns are ignored; an empty table gives an empty result.
    small_bucket and hot_code say when buckets are split and dealt out; no result depends on them.
    """
    spark, seed, c = docs.sparkSession, 0, F.col
    docs = only(docs, "doc_id", "text", *([key] if key else []))
    docs = docs.withColumnRenamed(key, "key") if key else docs.withColumn("key", F.lit(None).cast("long"))
    n_bytes = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = int(min(np.log2(MOST_COUNTERS), max(16, np.ceil(np.log2(max(1, n_bytes) / 64)))))
    while True:
        facts = cut(docs.mapInArrow(_facts(k, seed, bits), FACTS))
        rows = facts.filter("slice IS NULL").select("doc_id", "key", "n", "node", "other", "sketch")
        named = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.min("other").alias("lo"), F.max("other").alias("hi"), F.first("n").alias("n"))
        named = cut(named)
        if not named.filter("lo <> hi").limit(1).count():
            break
        seed += 1  # two sets had one 64-bit name
    order = spark.sparkContext.broadcast(rarity(facts.filter("slice IS NOT NULL").select("slice", "part", "small"), docs.rdd.getNumPartitions(), bits).tobytes())

    # buckets: rows (bucket, node, n, pos, at) with the earliest one as `first`. at: the position of the first shared n-gram, pos: of the last so far
    bucket, earliest = Window.partitionBy("token", "salt"), F.struct("pos", "n", "node")
    prefix = docs.mapInArrow(_prefixes(k, seed, num, den, order, bits, hot_code), "token long, node long, n int, pos int, hot boolean, head binary")
    prefix = prefix.withColumn("salt", F.when(c("hot"), F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int"))
    prefix = prefix.repartition("token", "salt").groupBy("token", "salt", "node").agg(F.min("n").cast("long").alias("n"), F.min("pos").cast("long").alias("pos"), F.first("hot").alias("hot"), F.first("head").alias("head"))
    prefix = prefix.withColumns({"many": F.count(F.lit(1)).over(bucket), "first": F.min(earliest).over(bucket)}).filter("many > 1 OR hot OR head IS NOT NULL")
    placed = cut(prefix.drop("salt"))
    classes = cut(named.select("node", "rep", "n", "sketch").join(placed.filter("head IS NOT NULL").select("node", "head"), "node"))
    plain = placed.filter("many > 1 AND NOT hot").select(c("token").alias("bucket"), "node", "n", "pos", "first")
    hot = placed.filter("hot").select(c("token").alias("bucket"), "node", "n", "pos", "first")
    centres = hot.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("first").alias("first")).filter("many > 1").select("bucket", "first")
    shared = plain.unionByName(hot.drop("first").join(centres, "bucket")).withColumns({"at": c("pos"), "last": F.lit(False)})

    def fits(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, depth: int) -> Column:
        length = F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num
        return length & ((F.least(n_a - pos_a, n_b - pos_b) + depth - 1) * (num + den) >= (n_a + n_b) * num)

    def wanted(nodes: DataFrame):
        """A Bloom filter of the ids of documents that stand for these classes, its bits, and the classes."""
        reps = cut(nodes.distinct().join(classes, "node").select("node", F.coalesce("rep", F.lit(NULL_ID)).alias("rep")))
        size = min(MOST_BLOOM_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(16 * max(1, reps.count()))))))
        held = np.zeros(size // 8, np.uint8)
        for r in reps.repartition(4).mapInArrow(_bloom(size), "held binary").collect():
            held |= np.frombuffer(r["held"], np.uint8)
        return spark.sparkContext.broadcast(held.tobytes()), size, reps

    def verified(pairs: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Those of the candidate pairs (a, b, at_a, at_b) that are links, and those that were compared: not the `tested` ones, nor what the
        suffix filter rules out; the rest by the exact intersection of the sets, which are taken from the texts again."""
        pairs = pairs.groupBy("a", "b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        sides = [f"{x}_{s}" for s in "ab" for x in ("n", "sketch", "head", "at")]
        near = cut(_joined(pairs, classes.drop("rep")).mapInArrow(_kept(tuple(sides), lambda *v: may_be_similar(v[:4], v[4:], num, den)), "a long, b long"))
        if not near.limit(1).count():
            return near, near
        held, size, reps = wanted(near.select(c("a").alias("node")).union(near.select("b")))
        sets = docs.mapInArrow(_sets(k, seed, held, size), "node long, shingles binary")
        sets = cut(sets.join(reps, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
        exact = lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
        return cut(_joined(near, sets).mapInArrow(_kept(("shingles_a", "shingles_b"), exact), "a long, b long")), near

    def star(rows: DataFrame, depth: int) -> DataFrame:
        met = rows.filter((c("node") != c("first.node")) & fits(c("n"), c("pos"), c("first.n"), c("first.pos"), depth))
        lower, centre = c("node") < c("first.node"), c("first.at") if depth > 1 else c("first.pos")
        either = lambda x, y: F.when(lower, x).otherwise(y)
        return met.select(either(c("node"), c("first.node")).alias("a"), either(c("first.node"), c("node")).alias("b"), either(c("at"), centre).alias("at_a"), either(centre, c("at")).alias("at_b"))

    def split(rows: DataFrame, depth: int) -> DataFrame:
        """The buckets of rows by one more shared n-gram; sets that can't share one more meet in a last bucket."""
        held, size, reps = wanted(rows.select("node"))
        tokens = docs.mapInArrow(_further(k, seed, num, den, order, bits, held, size, depth), "node long, tokens array<long>")
        tokens = cut(tokens.join(reps, "node", "left_semi").dropDuplicates(["node"]))
        each = rows.join(tokens, "node").select("bucket", "node", "n", "at", "pos", F.posexplode_outer(F.slice("tokens", (c("pos") + 2).cast("int"), F.lit(1 << 30))).alias("on", "token")).filter("token IS NOT NULL")
        each = each.select(F.xxhash64("bucket", "token").alias("bucket"), "node", "n", (c("pos") + 1 + c("on")).alias("pos"), "at", F.lit(False).alias("last"))
        ended = rows.filter(c("n") * num <= den * depth).select(F.xxhash64("bucket", F.lit("end")).alias("bucket"), "node", "n", "pos", "at", F.lit(True).alias("last"))
        out = cut(each.unionByName(ended).dropDuplicates(["bucket", "node"]))
        firsts = out.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("pos", "n", "node", "at")).alias("first")).filter("many > 1").drop("many")
        return out.join(firsts, "bucket")

    links, tested = verified(star(shared, 1), None)
    roots, depth, members = components(links), 1, shared
    while True:
        members = cut(members.select("bucket", "node", "n", "pos", "at", "last").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        mixed = cut(members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many"), F.max("last").alias("last")).filter("lo <> hi"))
        small = members.join(mixed.filter((c("many") <= small_bucket) | c("last")).select("bucket"), "bucket", "left_semi")
        left, right = (small.select("bucket", *[c(x).alias(f"{x}_{s}") for x in ("node", "n", "pos", "at", "root")]) for s in "ab")
        across = left.join(right, "bucket").filter((c("node_a") < c("node_b")) & (c("root_a") != c("root_b")) & fits(c("n_a"), c("pos_a"), c("n_b"), c("pos_b"), depth))
        more, compared = verified(across.select(c("node_a").alias("a"), c("node_b").alias("b"), "at_a", "at_b"), tested)
        found = more.limit(1).count() > 0
        if found:
            links, tested = links.unionByName(more), tested.unionByName(compared)
        large = mixed.filter((c("many") > small_bucket) & ~c("last")).select("bucket")
        if not large.limit(1).count():
            break
        members = split(members.join(large, "bucket", "left_semi"), depth)
        depth += 1
        more, compared = verified(star(members, depth), tested)
        links, tested = links.unionByName(more), tested.unionByName(compared)
        roots = components(links)
    if found:
        roots = components(links)
    out = _result(rows, classes, roots)
    return out if key else out.drop("group", "key")


def _result(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    placed = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(placed.join(least, "root").select("node", "component_id", F.col("root").alias("group")))
    linked = rows.filter("node IS NOT NULL").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "group", "key")
    alone = rows.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "key")
    return linked.unionByName(alone)


@tidy
def one_of_each(docs: DataFrame, columns: tuple[str, ...], k: int = 5, num: int = 80, den: int = 100, most_broadcast: int = 1_000_000) -> DataFrame:
    """The named columns (doc_id and text among them) of the rows that stay: of each group of linked rows that with the smallest doc_id, a null
    one coming last, and of rows with one doc_id that with the smallest hash of its text. Rows without words are linked with nothing and stay.

    Decisions are taken by row: of rows that share a doc_id but not their text some may stay and others go. Of rows equal in both one stays,
    that with the smallest other columns. Extra columns are ignored; an empty table gives an empty result.
    """
    c = F.col
    docs = only(docs, *columns).withColumn("text_key", F.xxhash64("text"))
    rows = cut(link_documents(docs.select("doc_id", "text", "text_key"), k, num, den, key="text_key").filter("group IS NOT NULL"))
    place = F.struct(c("doc_id").isNull().alias("none"), "doc_id", "key")
    best = rows.groupBy("group").agg(F.min(place).alias("best"))
    gone = cut(rows.join(best, "group").filter(~place.eqNullSafe(c("best"))).select(c("doc_id").alias("gone_id"), c("key").alias("gone_key")).distinct())
    same = c("doc_id").eqNullSafe(c("gone_id")) & (c("text_key") == c("gone_key"))
    small = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    kept = docs.join(small(gone), same, "left_anti")
    again = cut(rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(c("doc_id").alias("gone_id"), c("key").alias("gone_key")))
    if again.limit(1).count():
        again, rest = small(again), [x for x in columns if x not in ("doc_id", "text")]
        repeated = kept.join(again, same, "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(*rest, "text")).alias("row"))
        kept = kept.join(again, same, "left_anti").select(*columns).unionByName(repeated.select("doc_id", "row.*").select(*columns))
    return kept.select(*columns)
