"""Images in numpy: PNG decoding and encoding, resizing, and the perceptual hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from ..errors import BadInputError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


@dataclass(frozen=True)
class Guards:
    max_bytes: int = 16 << 20
    max_dim: int = 8192
    min_dim: int = 8


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB or grey image as PNG."""
    grey = rgb.ndim == 2
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1).astype(np.uint8)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes, guards: Guards = Guards()) -> np.ndarray:
    """(height, width, 3) bytes of an 8-bit PNG without interlacing. Anything else is bad input."""
    if len(data) > guards.max_bytes:
        raise BadInputError(f"image of {len(data)} bytes")
    if data[:8] != SIGNATURE:
        raise BadInputError("not a PNG image")
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
            if max(head[:2]) > guards.max_dim or min(head[:2]) < guards.min_dim:
                raise BadInputError(f"image of {head[0]} by {head[1]}")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise BadInputError("this kind of PNG isn't supported")
    w, h, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(idat), h * (w * channels + 1)), np.uint8).reshape(h, w * channels + 1)
    except (zlib.error, ValueError) as e:
        raise BadInputError("broken PNG data") from e
    pixels = _unfiltered(raw, channels).reshape(h, w, channels)
    if head[3] == 3:
        if palette is None or pixels.max() >= len(palette):
            raise BadInputError("broken PNG palette")
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for y, row in enumerate(raw):
        kind, line = int(row[0]), row[1:].copy()
        if kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            own = line.tolist()
            up = above.tolist()
            for x in range(len(own)):
                left = own[x - step] if x >= step else 0
                if kind == 3:
                    own[x] = (own[x] + (left + up[x]) // 2) & 255
                else:
                    corner = up[x - step] if x >= step else 0
                    guess = left + up[x] - corner
                    near = min((abs(guess - left), 0, left), (abs(guess - up[x]), 1, up[x]), (abs(guess - corner), 2, corner))
                    own[x] = (own[x] + near[2]) & 255
            line = np.array(own, np.uint8)
        elif kind > 4:
            raise BadInputError("broken PNG filter")
        out[y] = above = line
    return out


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(float) @ np.array([0.299, 0.587, 0.114])


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of equal areas."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        cells = np.arange(n)
        cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        return np.clip(cover, 0, None) * m / n
    return weights(img.shape[0], h) @ img @ weights(img.shape[1], w).T


def _bits(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask.ravel(), bitorder="little").tobytes(), "little")


def ahash(g: np.ndarray) -> int:
    small = np.rint(resized(g, 8, 8)).astype(int)
    return _bits(small > small.sum() // 64)


def dhash(g: np.ndarray) -> int:
    small = resized(g, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1] + 1e-9)


_N = np.arange(32)
_DCT = np.cos(np.pi / 32 * (_N[None, :] + 0.5) * _N[:, None])


def phash(g: np.ndarray) -> int:
    low = (_DCT @ resized(g, 32, 32) @ _DCT.T)[:8, :8]
    return _bits(low > np.median(low.ravel()[1:]))


KINDS = {"ahash": ahash, "phash": phash, "dhash": dhash}


def single(data: bytes, kind: str, guards: Guards = Guards()) -> bytes:
    """168 bytes: SHA-256 of the file, the hash of the whole, and of sixteen blocks."""
    g = grey(decode_png(data, guards))
    return hashlib.sha256(data).digest() + _hashes(g, kind)


def _hashes(g: np.ndarray, kind: str) -> bytes:
    f = KINDS[kind]
    rows, columns = np.linspace(0, g.shape[0], 5).astype(int), np.linspace(0, g.shape[1], 5).astype(int)
    blocks = [f(g[a:b, c:d]) for a, b in zip(rows, rows[1:], strict=False) for c, d in zip(columns, columns[1:], strict=False)]
    return struct.pack("<17Q", f(g), *blocks)


def bundle(data: bytes, guards: Guards = Guards()) -> bytes:
    """536 bytes: SHA-256, then the average, frequency and difference hashes, each after the SHA-256 again."""
    g, exact = grey(decode_png(data, guards)), hashlib.sha256(data).digest()
    return exact + b"".join(exact + _hashes(g, k) for k in KINDS)


WEIGHTS = {"phash": 0.4, "dhash": 0.3, "ahash": 0.1, "blocks": 0.1, "exact": 0.1}


def compare(a: bytes, b: bytes, weights: dict[str, float] = WEIGHTS, block_threshold: int = 12) -> float:
    """Likeness of two bundles from 0 to 1: weighted parts of equal bits, of blocks that match, and of equal files."""
    if len(a) != 536 or len(b) != 536:
        raise BadInputError("not image bundles")
    parts = {"exact": float(a[:32] == b[:32])}
    matched = total = 0
    for i, kind in enumerate(KINDS):
        x, y = (struct.unpack_from("<17Q", d, 32 + 168 * i + 32) for d in (a, b))
        parts[kind] = 1 - (x[0] ^ y[0]).bit_count() / 64
        matched += sum((p ^ q).bit_count() <= block_threshold for p, q in zip(x[1:], y[1:], strict=True))
        total += 16
    parts["blocks"] = matched / total
    return sum(weights[k] * v for k, v in parts.items()) / sum(weights.values())


def inspect(data: bytes, guards: Guards = Guards()) -> dict:
    rgb = decode_png(data, guards)
    g = grey(rgb)
    small = np.rint(resized(g, 8, 8)).astype(int)
    return {"width": rgb.shape[1], "height": rgb.shape[0], "grey32": np.rint(resized(g, 32, 32)).astype(np.uint8).tobytes(), "grey8": small.astype(np.uint8).tobytes(), "ahash_mean": int(small.sum() // 64)}
