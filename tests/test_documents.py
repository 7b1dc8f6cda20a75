import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from contentprint.errors import BadInputError
from contentprint.functions.documents import diff_spans, pdf_text, pooled, spectrum_png, viridis
from contentprint.functions.images import decode_png
from contentprint.registry import QUERIES


def pdf(content, deflate):
    body = zlib.compress(content) if deflate else content
    kind = b"/Filter /FlateDecode " if deflate else b""
    return b"%PDF-1.4\n1 0 obj <<" + kind + b"/Length %d>>\nstream\n" % len(body) + body + b"\nendstream endobj\n%%EOF"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(deflate):
    content = rb"BT /F1 12 Tf (Hello \(you\)\041) Tj 0 -14 Td [(Wor) -20 (ld)] TJ T* <414243> Tj ET"
    assert pdf_text(pdf(content, deflate)) == "Hello (you)!\nWorld\nABC"


def test_not_pdf():
    with pytest.raises(BadInputError):
        pdf_text(b"plain")


def test_diff():
    spans = diff_spans("Hello, World", "hello, world!")
    assert "".join(t for k, t in spans if k != "added") == "Hello, World" and "".join(t for k, t in spans if k != "removed") == "hello, world!"


def test_pictures():
    assert viridis(np.array([0.0, 1.0, np.nan])).tolist() == [[68, 1, 84], [253, 231, 37], [68, 1, 84]]
    assert pooled(np.arange(12.0).reshape(3, 4), 2, 2).tolist() == [[1, 3], [9, 11]]
    assert decode_png(spectrum_png(np.full((64, 40), -60.0))).shape == (40, 64, 3)


def test_markdown_of_whole_texts(spark, tmp_path):
    head = "A first sentence of more than thirty characters.\n"
    rules = [(r"(?s)```.*?```", " "), (r"`([^`]*)`", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^[ \t]*#{1,6}[ \t]*", ""), (r"(?m)^[ \t]*>[ \t]?", ""),
             (r"(?m)^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+", ""), (r"\*\*([^*]*)\*\*", r"\1"), (r"\*([^*]*)\*", r"\1"), (r"__([^_]*)__", r"\1"), (r"~~([^~]*)~~", r"\1"), (r"[ \t\n\r\f\x0b]+", " ")]
    rng = random.Random(4)
    bits = ["word", " ", "\n", "*", "**", "`", "```", "# ", "> ", "- ", "1. ", "[a](b)", "![c](d)", "__", "~~", "|", "!", "é"]
    texts = ["# Title\n" + head + "- one\n- two\n> said\n```\ncode\n```\n[link](http://x) and **bold**", None, "", head, *["".join(rng.choices(bits, k=80)) + "end" for _ in range(60)]]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")

    def brute(text):
        for pattern, out in rules:
            text = re.sub(pattern, out, text)
        return text.strip(" ")

    got = {r.record_id: r.text_md5 for r in QUERIES["markdown_whole_text"](spark, str(tmp_path)).collect()}
    assert brute(texts[0]) == "Title A first sentence of more than thirty characters. one two said link and bold"
    assert got == {i: None if t is None else hashlib.md5(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_hamming_of_whole_digests(spark, tmp_path):
    texts = ["a", "", None, "some longer text"]
    pq.write_table(pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = {r.record_id: (r.distance, r.match_pct) for r in QUERIES["hamming_whole_digests"](spark, str(tmp_path)).collect()}
    number = lambda x: int(hashlib.sha256(x.encode()).hexdigest(), 16)
    want = {i: (number(t) ^ number(t + "x")).bit_count() for i, t in enumerate(texts) if t is not None}
    assert got == {i: (n, round(100 * (1 - n / 256), 6)) for i, n in want.items()}
