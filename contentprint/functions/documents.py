"""Plain text of PDF files, differences of texts, and pictures of spectra."""

from __future__ import annotations

import difflib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadInputError
from .images import encode_png

STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
SHOWN = re.compile(rb"\[((?:\\.|\((?:\\.|[^()\\])*\)|[^\]])*)\]\s*TJ|\(((?:\\.|[^()\\])*)\)\s*(?:Tj|'|\")|<([0-9A-Fa-f\s]+)>\s*Tj|(T\*|Td|TD|ET)")
PART = re.compile(rb"\(((?:\\.|[^()\\])*)\)|<([0-9A-Fa-f\s]+)>")
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r?\n)|(.))", re.DOTALL)
# What the letters after a backslash stand for.
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(data: bytes) -> str:
    """The strings that the pages' content streams show, for plain and deflated streams in simple encodings; a new line wherever the text moves."""
    if not data.startswith(b"%PDF-"):
        raise BadInputError("not a PDF file")
    out: list[str] = []
    for head, body in STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error as e:
                raise BadInputError("broken PDF stream") from e
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for many, one, coded, moved in SHOWN.findall(body):
            if moved:
                out.append("\n")
            elif many:
                out += [_string(a, b) for a, b in PART.findall(many)]
            else:
                out.append(_string(one, coded))
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(out).split("\n")) if x)


def _string(plain: bytes, coded: bytes) -> str:
    if coded:
        digits = re.sub(rb"\s", b"", coded)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else LETTERS.get(m[3], m[3]), plain).decode("latin-1")


def diff_spans(before: str, after: str) -> list[tuple[str, str]]:
    """(kind, text) with kind equal, removed or added, from one text to the other."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, before, after, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(("equal", before[a:b]))
            continue
        out += [(k, t) for k, t in (("removed", before[a:b]), ("added", after[c:d])) if t]
    return out


def differences(before: Column | str, after: Column | str) -> Column:
    """diff_spans of two columns; null texts count as empty."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in diff_spans(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    return run(before, after)


# Nine stops of the viridis colour map.
VIRIDIS = np.array([(68, 1, 84), (71, 44, 122), (59, 81, 139), (44, 113, 142), (33, 144, 141), (39, 173, 129), (92, 200, 99), (170, 220, 50), (253, 231, 37)], float)


def viridis(t: np.ndarray) -> np.ndarray:
    """Colours of values from 0 to 1."""
    t = np.clip(np.nan_to_num(t), 0, 1) * (len(VIRIDIS) - 1)
    return np.rint(np.stack([np.interp(t, np.arange(len(VIRIDIS)), VIRIDIS[:, c]) for c in range(3)], axis=-1)).astype(np.uint8)


def pooled(grid: np.ndarray, h: int, w: int) -> np.ndarray:
    """The largest values of equal parts; never enlarged."""
    h, w = min(h, grid.shape[0]), min(w, grid.shape[1])
    rows, columns = (np.arange(n) * size // n for n, size in ((h, grid.shape[0]), (w, grid.shape[1])))
    return np.maximum.reduceat(np.maximum.reduceat(grid, rows, axis=0), columns, axis=1)


def spectrum_png(decibels: np.ndarray, h: int = 128, w: int = 512, lowest: float = -60.0) -> bytes:
    """(frames, bins) as a picture: time to the right, low frequencies at the bottom."""
    return encode_png(viridis(1 - pooled(decibels.T[::-1], h, w) / lowest))
