"""Token counts: only lengths leave the Arrow functions.

Texts, short or long, are split at safe boundaries (a blank or newline after a character that isn't white space), across which the
vocabulary's pre-tokenizer never matches. The library encodes each distinct stretch once while it is remembered, in batches of
about equal bytes, so that a very long text neither fills a batch nor makes one slow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import CACHED, words_of
from .common import only

BATCH_BYTES = 1 << 18
#: Safe boundaries at which what follows is a newline, or a blank and then no newline: one spelling for each key.
CUT = re.compile(r"(?<=\S)(?=\n| (?!\n))")


def balanced(items: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The items in order, in batches of at most `most` bytes unless one item is larger."""
    batch, size = [], 0
    for item in items:
        n = len(item.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(item)
        size += n
    if batch:
        yield batch


class Counter:
    """Counts of a tokenizers .json or a sentencepiece .model file."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        self.batch_bytes, self.known = batch_bytes, {}
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
            self.splits = False
        else:
            import json
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            with open(path) as f:
                told = json.load(f)
            pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            # the boundaries are proven for this pre-tokenizer alone, for texts that no normalizer changes and added tokens that hold no blank and
            # take none from around them; others get whole texts
            plain = all(not re.search(r"\s", t["content"]) and not any(t.get(x) for x in ("lstrip", "rstrip", "single_word")) for t in added)
            self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not told.get("normalizer") and plain

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for batch in balanced(texts, self.batch_bytes) for n in self.lengths(batch)]
        if len(self.known) > CACHED:
            self.known.clear()
        firsts, words = [], []
        for text in texts:
            parts = words_of(text)
            if parts is None:
                first, *rest = CUT.split(text)
                parts = first, [x[1:] if x[0] == " " else x for x in rest]
            firsts.append(parts[0])
            words.append(parts[1])
        new = list({w for own in words for w in own if w not in self.known})
        spelled = [w if w[:1] == "\n" else " " + w for w in new]
        at = 0
        for batch in balanced(spelled, self.batch_bytes):
            self.known.update(zip(new[at : at + len(batch)], self.lengths(batch), strict=True))
            at += len(batch)
        heads = [n for batch in balanced(firsts, self.batch_bytes) for n in self.lengths(batch)]
        return [n + sum(map(self.known.__getitem__, own)) for n, own in zip(heads, words, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    Whole texts, without begin, end or added special tokens; special strings inside texts as the library's default has them.
    Null counts as empty: no bytes, no tokens. Ids can be repeated or null. Extra columns are ignored; an empty table gives
    an empty result. path: a .json or .model file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, batch_bytes)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            counts: list[int] = []
            for group in balanced(texts, 1 << 21):
                counts += counter.count(group)
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
