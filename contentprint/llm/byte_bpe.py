"""Byte-level BPE by monoid tree reduction.

A text of two or more characters is encoded as a tree over its halves. Two neighbours join by re-encoding a window around their border that grows
on both sides until it reaches a safe cut: a blank or newline after a character that isn't white space. No match of the
splitting pattern holds white space after another character, and what a match takes depends only on the text from its start, so both
halves have a token border at every safe cut and no token beyond the cuts can change. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, parts

UNSAFE = re.compile(r"\s[ \n]")
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Texts of more characters are halved; shorter ones too, once, if they have two characters or more.
LEAF_CHARS = 256
CACHED = 150_000


class Words(dict):
    """Values of words as `make` gives them, forgotten when there are too many. Keys: a word stands for ' ' + word, or for itself if it starts with a newline."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) > CACHED:
            self.clear()
        value = self[word] = self.make(word if word[:1] == "\n" else " " + word)
        return value


class Firsts(Words):
    """The same for the text before a first safe cut, which stands for itself."""

    def __missing__(self, text: str):
        if len(self) > CACHED or len(text) > 64:
            self.clear()
        value = self[text] = self.make(text)
        return value


def words_of(text: str) -> tuple[str, list[str]] | None:
    """The text up to its first safe cut and the words after it, None where a blank follows white space."""
    if UNSAFE.search(text):
        return None
    first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


class ByteBPE:
    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(x) for x in self.tokens]
        self.leaf_chars = max(2, leaf_chars)
        self.words = Words(self._pack)
        self.firsts = Firsts(self._pack)

    def _pack(self, text: str) -> bytes:
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()

    def leaf(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text or (parts := words_of(text)) is None:
            return self._pack(text)
        return self.firsts[parts[0]] + b"".join(map(self.words.__getitem__, parts[1]))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, by at least one join unless it has a single character or none."""
        return self._tree(text, 0, len(text), max(1, min(self.leaf_chars, len(text) - 1)))

    def _tree(self, text: str, lo: int, hi: int, leaf_chars: int) -> bytes:
        if hi - lo <= leaf_chars:
            return self.leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid, leaf_chars), self._tree(text, mid, hi, leaf_chars))

    def join(self, text: str, lo: int, mid: int, hi: int, left: bytes, right: bytes) -> bytes:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        p, q, width = lo, hi, 32
        while mid - width > lo:
            if cuts := [m.start() for m in SAFE.finditer(text, mid - width, min(mid + 1, hi)) if m.start() > mid - width]:
                p = cuts[-1]
                break
            width *= 2
        if p == mid:  # a safe cut: nothing can change
            return left + right
        width = 32
        while mid + width < hi:
            if cut := SAFE.search(text, mid, mid + width):
                q = cut.start()
                break
            width *= 2
        head = len(left) - 4 * self._tokens_of(left, len(text[p:mid].encode()), -1)
        tail = 4 * self._tokens_of(right, len(text[mid:q].encode()), 1)
        return left[:head] + self.leaf(text[p:q]) + right[tail:]

    def _tokens_of(self, ids: bytes, n_bytes: int, step: int) -> int:
        """How many tokens make up n_bytes, counted from the start (step 1) or from the end (-1): both are borders of tokens."""
        held, lengths, n = memoryview(ids).cast("I"), self.lengths, 0
        at = 0 if step > 0 else -1
        while n_bytes > 0:
            n_bytes -= lengths[held[at]]
            at += step
            n += 1
        return n

    def decode(self, ids: bytes) -> bytes:
        n = len(ids) // 4
        return self._concat(memoryview(ids).cast("I"), 0, n, max(1, min(self.leaf_chars, n - 1)))

    def _concat(self, ids: memoryview, lo: int, hi: int, leaf: int) -> bytes:
        if hi - lo <= leaf:
            return b"".join(map(self.tokens.__getitem__, ids[lo:hi]))
        mid = (lo + hi) // 2
        return self._concat(ids, lo, mid, leaf) + self._concat(ids, mid, hi, leaf)


def encode_texts(docs: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, digests: bool | tuple[str, ...] = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, then ids (binary, little-endian unsigned 32-bit) and decoded (binary).

    With digests, the lowercase hex SHA-256 of either instead: ids_sha256, decoded_sha256; a tuple names those that are given so. Every text is decoded. Texts are encoded whole, without
    special tokens; null counts as empty: no tokens. Ids can be repeated or null and are passed on. Extra columns are ignored;
    an empty table gives an empty result. path: a rank file on every executor.
    """
    hashed = ("ids", "decoded") if digests is True else digests or ()
    outs = [f"{x}_sha256 string" if x in hashed else f"{x} binary" for x in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, pattern, leaf_chars)
        shown = [(lambda raw: hashlib.sha256(raw).hexdigest()) if x in hashed else (lambda raw: raw) for x in ("ids", "decoded")]
        kinds = [pa.string() if x in hashed else pa.binary() for x in ("ids", "decoded")]
        for batch in parts(batches, "text"):
            counts, made = [], [[] for _ in outs]
            for text in batch["text"].to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                made[0].append(shown[0](ids))
                made[1].append(shown[1](bpe.decode(ids)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_tokens": pa.array(counts, pa.int64()), **{name.split()[0]: pa.array(own, kind) for name, own, kind in zip(outs, made, kinds, strict=True)}})

    return only(docs, "doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *outs]))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text. Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, pattern)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array([None if x is None else bpe.decode(x).decode(errors="replace") for x in batch["ids"].to_pylist()], pa.string())})

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
