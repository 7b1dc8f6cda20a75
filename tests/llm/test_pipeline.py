import hashlib
import os
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as C
from contentprint.llm.byte_bpe import ByteBPE
from contentprint.llm.ngram_join import Shingler
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_ngram_join import brute as groups_of

WORDS = {"en": "the and of to thing water house running mountain paper window street".split(), "fr": "le et de la chose eau maison été montagne papier fenêtre rue".split()}


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        rows.append([i, "\n".join(" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "x", "ed"]) for _ in range(12)) for _ in range(4)), lang])
    item = "one benchmark passage that has quite some words which nobody else would write down in this order here"
    for i in (3, 50):
        rows[i][1] += " " + item
    for i in range(10, 16):
        rows[i][1] += "\nThis very common footer line is on many pages"
    rows[21][1] = rows[22][1] + " end"
    rows += [[200, "12345 !!", None], [201, None, "en"], [202, "", None]]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], [(0, item)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, bench = corpus()
    names = C.COLUMNS
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()][i]) for i, n in enumerate(names)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [b[0] for b in bench], "text": [b[1] for b in bench]}), tmp_path / "benchmark.parquet")
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = C.language_id(spark, docs, d)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == set(range(120)) and tuple(kept.columns) == names

    lines = C.line_dedup(spark, kept, d)
    want = {i: t for i, _, _, t in lines_left(sorted(texts.items())) if t.strip()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and sum("footer" in t for t in want.values()) == 1

    near = C.near_duplicates(spark, lines, d)
    stay = {c for _, _, c in groups_of(sorted(want.items()), 5, 80, 100)}
    assert {r.doc_id for r in near.collect()} == stay and 22 not in stay and 21 in stay

    clean = C.benchmark_decontamination(spark, near, d)
    assert {r.doc_id for r in clean.collect()} == stay - {3, 50} and tuple(clean.columns) == names

    bpe = ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: bytes(r.ids) for r in C.run(spark, d).collect()}
    assert set(got) == stay - {3, 50}
    assert all(bpe.decode(ids).decode() == want[i] for i, ids in got.items())


ODD = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, gone_id int, `group` int"


def odd(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", 1, 2) for d, t in rows], ODD)


def benchmark_at(tmp_path, rows):
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in rows], pa.int64()), "text": pa.array([b[1] for b in rows], pa.string())}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_stages_judge_rows_not_ids(spark, tmp_path):
    base = "some words that make up a document of a fair length which nobody else has written before now"
    other, item = "an entirely different text about rivers and mountains and the towns that lie between them", "a benchmark passage of more than five words"
    rows = [(5, base), (5, other), (7, base + " x"), (None, base), (None, item + " and more"), (None, other + " y y y y y y y"), (8, "zz"), (8, "zz"), (9, None), (9, None), (10, "")]
    kept = sorted([(r.doc_id, r.text) for r in C.near_duplicates(spark, odd(spark, rows), "").collect()], key=str)
    assert kept == sorted([(5, base), (5, other), (None, item + " and more"), (None, other + " y y y y y y y"), (8, "zz"), (9, None), (9, None), (10, "")], key=str)
    d = benchmark_at(tmp_path, [(1, item), (2, None)])
    clean = C.benchmark_decontamination(spark, odd(spark, rows), d).collect()
    assert sorted([(r.doc_id, r.text) for r in clean], key=str) == sorted([r for r in rows if r[1] != item + " and more"], key=str)
    lines = C.line_dedup(spark, odd(spark, [*rows, (11, f"{base}\n{other}"), (12, base)]), d).collect()
    got = sorted([(r.doc_id, r.text) for r in lines], key=str)
    want = [(i, t) for i, _, _, t in lines_left([*rows, (11, f"{base}\n{other}"), (12, base)]) if t.strip()]
    assert got == sorted(want, key=str)
    assert sorted(r.n_tokens for r in C.tokens(spark, odd(spark, rows), d).collect())[:3] == [0, 0, 0]
    assert C.language_id(spark, odd(spark, [*rows, (None, None)]), d).filter("text IS NULL OR text = ''").count() == 0


def test_empty_tables_stay_empty(spark, tmp_path):
    d = benchmark_at(tmp_path, [])
    for name, stage in C.STAGES:
        assert stage(spark, odd(spark, []), d).count() == 0, name


def test_scratch_tables_go(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    held = lambda: {x for x in os.listdir(folder) if x.startswith("contentprint-")}
    before = held()
    out = C.near_duplicates(spark, odd(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")]), "")
    assert len(held() - before) <= 3 and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_token_stage_decodes_every_text(spark):
    texts = {1: "plain text\nof two lines", 2: "été 東京 👍🏽 \t  end ", 3: "", 4: "a" * 5000}
    rows = C.tokens(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_stage_list():
    assert [name for name, _ in C.STAGES] == ["language_id", "line_dedup", "near_duplicates", "benchmark_decontamination", "tokens"]
    assert len(Shingler(5)(b"a b c d e f")) == 2 and np.all(np.diff(Shingler(1)(b"a b c").astype(float)) > 0)
