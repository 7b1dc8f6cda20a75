"""Text fingerprint kernels of the wire profile: MinHash on XXH3 and TLSH, as Arrow functions."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInputError
from ..functions.documents import pdf_text
from ..functions.text import html_text, markdown_text
from ..functions.unicode import canonical, config_tag, tokenizer
from .records import config_hash

SEED = 0xC0FFEE5EED
SLOTS, WORDS = 128, 5
HEADER = struct.pack("<H6x", 1)


def minhash_slots(tokens: list[str], k: int = WORDS, slots: int = SLOTS) -> np.ndarray:
    """Least (low + i high) mod 2^64 of the shingles' XXH3-128 for each i; zeros without tokens."""
    if not tokens:
        return np.zeros(slots, np.uint64)
    shingles = {" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))}
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64).reshape(-1, 2)
    high, low = both[:, 0], both[:, 1]
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    steps = np.arange(slots, dtype=np.uint64)
    for at in range(0, len(low), 4096):  # bounded rows at a time
        out = np.minimum(out, (low[at : at + 4096, None] + steps[None, :] * high[at : at + 4096, None]).min(axis=0))
    return out


def pack(slots: np.ndarray) -> bytes:
    return HEADER + slots.astype("<u8").tobytes()


def unpack(fingerprint: bytes) -> np.ndarray:
    if len(fingerprint) < 8 or (len(fingerprint) - 8) % 8 or fingerprint[:2] != HEADER[:2]:
        raise BadInputError("not a MinHash fingerprint")
    return np.frombuffer(fingerprint, "<u8", offset=8)


def minhash_fingerprint(text: str, k: int = WORDS, name: str = "word", **options) -> bytes:
    return pack(minhash_slots(tokenizer(name)(canonical(text, **options)), k))


def simhash_fingerprint(text: str, weights: Callable[[str], float] | None = None, name: str = "word", **options) -> bytes:
    """64 bits over tokens by frequency, times weights(token) where given."""
    counts: dict[str, float] = {}
    for token in tokenizer(name)(canonical(text, **options)):
        counts[token] = counts.get(token, 0) + (weights(token) if weights else 1.0)
    sums = np.zeros(64)
    for token, w in counts.items():
        bits = np.unpackbits(np.frombuffer(xxhash.xxh3_64_intdigest(token, SEED).to_bytes(8, "little"), np.uint8), bitorder="little")
        sums += np.where(bits, w, -w)
    return np.packbits(sums > 0, bitorder="little").tobytes()


# ---------------------------------------------------------------- TLSH

def _pearson_table() -> list[int]:
    """A permutation of the byte values from a fixed linear congruence."""
    table, x = list(range(256)), 1
    for i in range(255, 0, -1):
        x = (1103515245 * x + 12345) % 2**31
        j = x % (i + 1)
        table[i], table[j] = table[j], table[i]
    return table


_T = np.array(_pearson_table(), np.uint8)


def tlsh(data: bytes, permutation: np.ndarray | None = None) -> str | None:
    """A locality-sensitive digest of 128 buckets and one checksum byte: 70 hexadecimal digits. None below 50 bytes or without variety.

    permutation: the 256 byte values in the order of the hash table; digests compare only under one. The default is made by a rule; for digests
    that other tools understand, pass the published table.
    """
    if len(data) < 50:
        return None
    table = _T if permutation is None else np.asarray(permutation, np.uint8)
    b = np.frombuffer(data, np.uint8)
    w = [b[4 - i : len(b) - i] for i in range(5)]  # w[0] is the newest byte of each window of five
    counts = np.zeros(256, np.int64)
    for salt, (i, j) in zip((2, 3, 5, 7, 11, 13), ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)), strict=True):
        h = table[table[table[table[np.uint8(salt)] ^ w[0]] ^ w[i]] ^ w[j]]
        counts += np.bincount(h, minlength=256)
    checksum, mixed = 0, (table[table[1] ^ w[0]] ^ w[1]).tolist()
    own = table.tolist()
    for x in mixed:
        checksum = own[x ^ checksum]
    buckets = counts[:128]
    q1, q2, q3 = np.sort(buckets)[[31, 63, 95]]
    if q3 == 0 or (buckets > 0).sum() < 64:
        return None
    codes = (buckets > q1).astype(int) + (buckets > q2) + (buckets > q3)
    packed = [int(codes[i]) | int(codes[i + 1]) << 2 | int(codes[i + 2]) << 4 | int(codes[i + 3]) << 6 for i in range(0, 128, 4)]
    length = int(np.floor(np.log(len(data)) / np.log(1.5))) & 255
    ratios = (int(q1 * 100 / q3) % 16) << 4 | int(q2 * 100 / q3) % 16
    return bytes([checksum, length, ratios, *reversed(packed)]).hex()


def _around(a: int, b: int, n: int) -> int:
    d = abs(a - b)
    return min(d, n - d)


def _quarters() -> np.ndarray:
    """Of two bytes of four 2-bit codes each, the sum of their distances; three counts six."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    apart = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(apart == 3, 6, apart).sum(axis=2)


_APART = _quarters()


def tlsh_distance(a: str, b: str) -> int:
    """0 for equal digests; near-identical up to about 30, similar up to about 100."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = int(x[0] != y[0])
    d = _around(x[1], y[1], 256)
    total += d if d <= 1 else d * 12
    for p, q in ((x[2] >> 4, y[2] >> 4), (x[2] & 15, y[2] & 15)):
        d = _around(p, q, 16)
        total += d if d <= 1 else (d - 1) * 12
    return total + int(_APART[np.frombuffer(x, np.uint8, offset=3), np.frombuffer(y, np.uint8, offset=3)].sum())


# ---------------------------------------------------------------- DataFrames

ALGORITHMS = {"minhash-h128": minhash_fingerprint, "minhash-lsh-h128": minhash_fingerprint, "simhash-b64-tf": simhash_fingerprint}


def fingerprint(records: DataFrame, algorithm: str = "minhash-h128", **options) -> DataFrame:
    """records with algorithm and fingerprint; null texts have none, and TLSH has none for texts that it can't digest."""
    if algorithm != "tlsh-128-1" and algorithm not in ALGORITHMS:
        raise BadInputError(f"algorithm {algorithm!r}")

    def one(text: str | None) -> bytes | None:
        if text is None:
            return None
        if algorithm == "tlsh-128-1":
            digest = tlsh(canonical(text, **options).encode("utf-8", "replace"))
            return digest.encode() if digest else None
        return ALGORITHMS[algorithm](text, **options)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return records.withColumn("algorithm", F.lit(algorithm)).withColumn("fingerprint", run("text"))


def tlsh_compare(pairs: DataFrame) -> DataFrame:
    """pairs (a, b hexadecimal digests) with distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if p is None or q is None else tlsh_distance(p, q) for p, q in both], pa.int32())], [*batch.schema.names, "distance"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInArrow(run, f"{schema}, distance int")


def register(spark) -> None:
    """The kernels as SQL functions."""
    for name, f, kind in (("fp_minhash", minhash_fingerprint, "binary"), ("fp_simhash", simhash_fingerprint, "binary"), ("fp_canonicalize", canonical, "string"), ("fp_tlsh", lambda t: tlsh(canonical(t).encode()), "string"), ("fp_tokenize", lambda t: tokenizer("word")(canonical(t)), "array<string>")):
        def column(s: pd.Series, f=f) -> pd.Series:
            return s.map(lambda t: None if t is None else f(t))

        def typed(s):
            return column(s)

        typed.__annotations__ = {"s": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(typed, kind))


class EmbeddingProvider:
    """What turns texts, images or clips into vectors. Implementations bring their own model; the engine has none."""

    model_id = "none"

    def embed(self, items: list) -> np.ndarray:
        raise NotImplementedError


class HashingProvider(EmbeddingProvider):
    """Hashed word counts, for tests and as the simplest provider."""

    model_id = "hashing-64"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, items: list) -> np.ndarray:
        out = np.zeros((len(items), self.dim), np.float32)
        for i, text in enumerate(items):
            for w in (text or "").lower().split():
                out[i, xxhash.xxh3_64_intdigest(w) % self.dim] += 1
        return out


def embed(records: DataFrame, provider: EmbeddingProvider, column: str = "text") -> DataFrame:
    """records with embedding and model_id; a provider that returns an empty vector is an error."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        vectors = provider.embed(s.tolist())
        if vectors.shape[1] == 0:
            raise BadInputError("the provider returned an empty vector")
        return pd.Series(list(vectors.astype(np.float32)))

    return records.withColumn("embedding", run(column)).withColumn("model_id", F.lit(provider.model_id))


class Shingles:
    """SQL table function shingles(text, k): position, shingle."""

    def eval(self, text: str, k: int):
        tokens = tokenizer("word")(canonical(text or ""))
        for i in range(max(1, len(tokens) - k + 1) if tokens else 0):
            yield i, " ".join(tokens[i : i + k])


class LshBands:
    """SQL table function lsh_bands(fingerprint, bands, rows): band, bucket."""

    def eval(self, fingerprint: bytes, n_bands: int, rows: int):
        slots = unpack(bytes(fingerprint))
        for b in range(n_bands):
            yield b, xxhash.xxh3_128_hexdigest(slots[b * rows : (b + 1) * rows].tobytes())


def register_tables(spark) -> None:
    spark.udtf.register("shingles", F.udtf(Shingles, returnType="position int, shingle string"))
    spark.udtf.register("lsh_bands", F.udtf(LshBands, returnType="band int, bucket string"))


# ---------------------------------------------------------------- what an upload or an inspection asks for

PREPARED = ("html", "markdown", "pdf")


def prepared(records: DataFrame, kind: str) -> DataFrame:
    """records with `text` taken from `content` (bytes; UTF-8 for html and markdown) and status 200, or null and 400 for what can't be read."""
    if kind not in PREPARED:
        raise BadInputError(f"kind {kind!r}")
    if kind == "pdf":
        @F.pandas_udf("string")
        def read(s: pd.Series) -> pd.Series:
            return s.map(_pdf_or_none)

        out = records.withColumn("text", read("content"))
    else:
        plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        out = records.withColumn("text", (html_text if kind == "html" else markdown_text)(plain))
    return out.withColumn("status", F.when(F.col("text").isNull(), 400).otherwise(200))


def _pdf_or_none(data: bytes | None) -> str | None:
    try:
        return None if data is None else pdf_text(bytes(data))
    except BadInputError:
        return None


def prepared_fingerprint(records: DataFrame, kind: str, algorithm: str = "minhash-h128", **options) -> DataFrame:
    """An upload in one step: the content's text and its fingerprint; both are null, and status is 400, for what can't be read."""
    return fingerprint(prepared(records, kind), algorithm, **options)


def inspected(records: DataFrame, k: int = WORDS, name: str = "word", most_bytes: int = 8192, most_items: int = 256, **options) -> DataFrame:
    """What an inspection page shows of (record_id, text): raw and canonical text of at most most_bytes (whole characters), at most most_items
    tokens and shingles beside how many there are, the MinHash in hexadecimal, and the configuration's hash. Null texts count as empty."""
    split = tokenizer(name)

    def cut(text: str) -> str:
        return text.encode("utf-8", "replace")[:most_bytes].decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t or "" for t in batch["text"].to_pylist()]
            made = [canonical(t, **options) for t in raws]
            tokens = [split(t) for t in made]
            runs = [[" ".join(w[i : i + k]) for i in range(min(most_items, max(1, len(w) - k + 1)))] if w else [] for w in tokens]
            yield pa.record_batch({
                "record_id": batch["record_id"], "raw": pa.array([cut(t) for t in raws], pa.string()), "canonical": pa.array([cut(t) for t in made], pa.string()),
                "tokens": pa.array([w[:most_items] for w in tokens], pa.list_(pa.string())), "n_tokens": pa.array([len(w) for w in tokens], pa.int64()),
                "shingles": pa.array(runs, pa.list_(pa.string())), "n_shingles": pa.array([max(1, len(w) - k + 1) if w else 0 for w in tokens], pa.int64()),
                "fingerprint": pa.array([pack(minhash_slots(w, k)).hex() for w in tokens], pa.string()),
            })

    out = records.select("record_id", "text").mapInArrow(run, f"record_id {dict(records.dtypes)['record_id']}, raw string, canonical string, tokens array<string>, n_tokens long, shingles array<string>, n_shingles long, fingerprint string")
    return out.withColumn("config_hash", config_hash(",".join(f"{a}={b}" for a, b in sorted(options.items())), config_tag(k, name), "minhash-h128"))
