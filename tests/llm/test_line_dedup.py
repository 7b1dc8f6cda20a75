import random

import numpy as np
from pyspark.sql import functions as F

import pyarrow as pa

from contentprint.llm.line_dedup import PerfectHash, Shard, _build_shard, dedup_lines

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    owners = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(lower(line.strip(BLANK)), set()).add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = -(2**63) if d is None else d
        keys = [lower(x.strip(BLANK)) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= 20 and len(owners[k]) >= 3 and max(owners[k]) != me)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    pool = [f"A Repeated line number {i} of some length" for i in range(8)] + ["short", "", "É" * 19, "É" * 20, "  a repeated LINE number 1 of some length\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for i in range(60)]
    return [*rows, (5, rows[5][1]), (None, pool[0]), (None, None), (70, "x" * 100_000 + "\n" + pool[0] + "\n" + pool[0])]


def test_equals_brute_force_on_both_paths(docs):
    rows = sample()
    df = docs(rows).withColumn("TEXT_2", F.lit(1)).withColumn("line", F.lit("x"))
    for most in (64 << 20, 0):
        got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(df, broadcast_bytes=most).collect()], key=str)
        assert got == brute(rows)


def test_empty_table_and_kept_columns(docs):
    assert dedup_lines(docs([])).count() == 0
    assert dedup_lines(docs([(1, "a")]), keep=("lang",)).collect()[0].lang == "en"


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    perfect = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(perfect.index(keys)) == list(range(len(keys)))


def test_small_shards_and_a_hot_line(docs):
    """Shards of a few lines, one of which most documents ask for: it is held by several tasks."""
    rows = [(i, f"the line that is in nearly all documents\n{'own line of this document ' * 2}{i % 40}") for i in range(200)] + sample()
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs(rows), shard_lines=8, broadcast_bytes=0).collect()], key=str)
    assert got == brute(rows)


def test_equal_half_hashes_stay_apart():
    rows = [(5, 1, 3, 10), (5, 2, 7, 11), (5, 3, 1, 12), (6, 1, 4, 13)]
    table = pa.table({"shard": [0] * 4, **{c: [r[i] for r in rows] for i, c in enumerate(("h1", "h2", "n", "owner"))}})
    shard = Shard(_build_shard(table).to_pylist()[0])
    ask = np.array([r[0] for r in rows] + [5, 7], np.uint64), np.array([r[1] for r in rows] + [9, 1], np.uint64)
    counts, owners = shard.probe(*ask)
    assert counts.tolist() == [3, 7, 1, 4, 0, 0] and owners.tolist()[:4] == [10, 11, 12, 13]
