import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from contentprint.llm.byte_bpe import ByteBPE, decode_ids, encode_texts
from contentprint.llm.token_counts import Counter, balanced, count_tokens

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
with open(RANKS, "rb") as f:
    LIBRARY = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
ALPHABET = ["a", "the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", "'re", "'", "l", "é", "漢", "🙂", "12", "!!", "<|endoftext|>", "　", "x" * 40]


def texts(n, size):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [2, 3, 7, 50, 8192])
def test_tree_equals_library(leaf):
    bpe = ByteBPE(RANKS, P.PATTERN, leaf)
    for text in [*texts(150, 60), "", "a" * 300, " " * 90, "word " * 200]:
        want = np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
        assert bpe.encode(text) == want, repr(text)
        assert bpe.decode(want) == text.encode()


def test_every_text_of_two_characters_reaches_a_join():
    bpe, seen = ByteBPE(RANKS, P.PATTERN), []
    bpe.join = lambda *a, join=bpe.join: seen.append(1) or join(*a)
    for text in [*texts(60, 40), "ab", "word", "very long text " * 500]:
        seen.clear()
        assert bpe.encode(text) == np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
        assert bool(seen) == (len(text) >= 2)


def test_encode_and_decode_tables(spark, docs):
    rows = [(1, "Hello there\nyou"), (1, "Hello there\nyou"), (None, None), (3, ""), (4, "long " * 9000)]
    df = docs(rows).selectExpr("*", "1 AS Text_", "2 AS extra")
    got = encode_texts(df, RANKS, P.PATTERN, leaf_chars=64)
    out = [(r.doc_id, r.n_tokens, bytes(r.decoded).decode()) for r in got.collect()]
    assert sorted(out, key=str) == sorted([(a, len(LIBRARY.encode_ordinary(b or "")), b or "") for a, b in rows], key=str)
    assert sorted(r.text for r in decode_ids(got, RANKS, P.PATTERN).collect()) == sorted(b or "" for _, b in rows)
    one = encode_texts(df.filter("doc_id = 4"), RANKS, P.PATTERN, digests=True).collect()[0]
    assert one.decoded_sha256 == hashlib.sha256(("long " * 9000).encode()).hexdigest()
    assert encode_texts(docs([]), RANKS, P.PATTERN).count() == 0


def test_counts_equal_library(spark, docs):
    library = Tokenizer.from_file(JSON)
    rows = list(enumerate([*texts(200, 80), "", "tail \n", "z" * 5000, "very long text\n" * 4000]))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs([*rows, (999, None)]), JSON).collect()}
    for i, text in rows:
        n = len(library.encode(text, add_special_tokens=False))
        assert got[i] == (len(text.encode()), n, n > 512)
    assert got[999] == (0, 0, False)
    assert count_tokens(docs([]), JSON).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_libraries_get_whole_texts(name):
    import sentencepiece

    some = [x for x in texts(40, 30)]
    path = P.path(name)
    want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x)) for x in some] if name.endswith("model") else [len(Tokenizer.from_file(path).encode(x, add_special_tokens=False)) for x in some]
    assert Counter(path).count(some) == want


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"added": "two words"}, {"added": "|end|", "lstrip": True}, {"added": "|end|"}])
def test_vocabularies_that_look_across_blanks_get_whole_texts(tmp_path, change):
    import json

    with open(JSON) as f:
        told = json.load(f)
    if "normalizer" in change:
        told["normalizer"] = change["normalizer"]
    else:
        told["added_tokens"].append({"id": 60_000, "content": change["added"], "single_word": False, "lstrip": change.get("lstrip", False), "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told))
    some = ["Here are two words and |end| more", "A  |end|  B two words", " two", "words"]
    counter = Counter(str(path))
    assert bool(counter.splits) == (change == {"added": "|end|"})
    assert counter.count(some) == [len(Tokenizer.from_file(str(path)).encode(x, add_special_tokens=False)) for x in some]


def test_batches_are_balanced():
    assert list(balanced(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]
