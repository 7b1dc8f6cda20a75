"""WARC records and their derivatives.

`responses` lays pages out as WARC/1.1 response records, `parse` reads records back from bytes, `derive` turns every response record into a metadata record
and a plain-text conversion record that refer to it, and `serialize` writes records as bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, parts
from .html_text import read_page, title_of

VERSION = "WARC/1.1"
#: Names of records without an id are made from their content under this namespace.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:contentprint:warc")
#: Pages carry no date of capture; records made from them have this one unless the caller says otherwise.
UNDATED = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    """A name that depends on the parts alone, so that a lost and repeated task gives the same one."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode("utf-8", "replace") if isinstance(p, str) else p
        h.update(len(raw).to_bytes(8, "little") + raw)
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, h.hexdigest())}>"


def headers_of(fields: dict[str, str], block: bytes) -> dict[str, str]:
    """The fields without empty ones, with the block's digest and length."""
    out = {k: re.sub(r"[\r\n]+[ \t]*", " ", v) for k, v in fields.items() if v}
    out.setdefault("WARC-Block-Digest", digest(block))
    out["Content-Length"] = str(len(block))
    return out


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _unpacked(data) -> Iterator[bytes]:
    """The content of a buffer in pieces, gzip members unpacked one after another; a member that is corrupt ends it after what it gave."""
    view, at = memoryview(data).cast("B"), 0
    if view[:2] != b"\x1f\x8b":
        for at in range(0, len(view), 1 << 20):
            yield bytes(view[at : at + (1 << 20)])
        return
    while view[at : at + 2] == b"\x1f\x8b":
        member, step = zlib.decompressobj(31), 1 << 10
        while not member.eof and at < len(view):
            piece = view[at : at + step]  # pieces grow, so that small members cost little and large ones few calls
            try:
                out = member.decompress(piece)
            except zlib.error:
                return
            at += len(piece) - len(member.unused_data)
            step = min(2 * step, 1 << 18)
            if out:
                yield out


class _Feed:
    """What is left of a content that comes in pieces; only a record at a time is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def starts(self, mark: bytes) -> bool:
        while len(self.held) < len(mark) and self._more():
            pass
        return self.held.startswith(mark)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(memoryview(self.held)[:n])
        del self.held[:n]
        return out

    def before(self, mark: bytes) -> bytes | None:
        """What stands before the mark, None (and nothing taken) if it doesn't come."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(found)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; gzip members are unpacked. What isn't a record ends the reading.

    A block that the file doesn't hold whole, as it ends or is corrupt, gets the field WARC-Truncated. A record whose length isn't a
    number reaches to the next record.
    """
    feed = _Feed(_unpacked(data))
    while feed.starts(b"WARC/"):
        head = feed.before(b"\r\n\r\n")
        if head is None:
            return
        feed.take(4)
        headers: dict[str, str] = {}
        last = ""
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                headers[last] += " " + line.strip()
            elif ":" in line:
                last, value = line.split(":", 1)
                headers[last := last.strip()] = value.strip()
        size = field(headers, "Content-Length").strip()
        if re.fullmatch(r"[0-9]{1,18}", size):
            block = feed.take(int(size))
            if len(block) < int(size):
                headers.setdefault("WARC-Truncated", "unspecified")
        else:
            block = feed.before(b"\r\n\r\nWARC/")
            block = feed.take(1 << 62) if block is None else block
        yield headers, block
        while feed.starts(b"\r\n"):
            feed.take(2)


def field(headers: dict[str, str], name: str) -> str:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), "")


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and body of a response; all is body if there is no HTTP head."""
    if block[:5] != b"HTTP/":
        return "", {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}, body


# Codecs that aren't character sets of texts, or cost more than time in proportion.
NOT_CHARSETS = frozenset("idna mbcs oem punycode raw_unicode_escape undefined unicode_escape".split())


def decoded(body: bytes, http: dict[str, str]) -> str:
    """The body's characters under the charset that its type names; UTF-8 under none or an unknown one. What doesn't decode becomes U+FFFD."""
    m = re.search(r"charset\s*=\s*\"?([\w.:-]+)", field(http, "Content-Type"), re.IGNORECASE)
    name = m[1].lower().replace("-", "_") if m else "utf_8"
    try:
        return body.decode("utf_8" if name in NOT_CHARSETS else name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    """A chunked body's content; as far as it can be read."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return body if not out else b"".join(out)
        n = int(size, 16)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if not n:
            break
    return b"".join(out) if out else body


def _inflated(body: bytes, bits: tuple[int, ...]) -> bytes | None:
    for window in bits:
        tool = zlib.decompressobj(window)
        out = []
        try:
            for at in range(0, len(body), 1 << 16):
                out.append(tool.decompress(body[at : at + (1 << 16)]))
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return None if body else b""


def content(body: bytes, http: dict[str, str]) -> bytes | None:
    """The body without its transfer and content codings, as far as they can be undone; None for a coding that can't be undone here."""
    if "chunked" in field(http, "Transfer-Encoding").lower():
        body = _unchunked(body)
    for coding in reversed([x.strip() for x in field(http, "Content-Encoding").lower().split(",")]):
        if coding in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
            body = b"".join(_unpacked(body))
        elif coding == "deflate":
            body = _inflated(body, (15, -15))
        elif coding == "zstd":
            import zstandard

            try:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            except zstandard.ZstdError:
                body = None
        elif coding not in ("", "identity", "gzip", "x-gzip"):  # crawlers often undo gzip and leave the header
            body = None
        if body is None:
            return None
    return body


# Types without a page whose content is text.
TEXT_TYPES = frozenset(("application/json", "application/ld+json", "application/xml", "application/javascript"))
PAGE_TYPES = frozenset(("", "text/html", "application/xhtml+xml"))


def derivatives(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata record and the conversion record of a response: title, language and outlinks of a page and its text block by block, the text of
    other types as it is, nothing of what isn't text."""
    status, http, body = split_http(block)
    source = field(headers, "WARC-Record-ID") or record_id("response", field(headers, "WARC-Target-URI"), block)
    payload = field(headers, "WARC-Payload-Digest") or digest(body)
    raw = content(body, http)
    page = "" if raw is None else decoded(raw, http)
    kind = field(http, "Content-Type").split(";")[0].strip().lower()
    read = read_page(page if kind in PAGE_TYPES else "")
    text = "\n".join(b.text for b in read.blocks) if kind in PAGE_TYPES else page if kind.startswith("text/") or kind in TEXT_TYPES else ""
    truncated = field(headers, "WARC-Truncated")
    facts = {
        "source-record-id": source, "source-block-digest": field(headers, "WARC-Block-Digest") or digest(block), "source-payload-digest": payload,
        "source-content-type": field(headers, "Content-Type"), "source-truncated": truncated, "http-status": status, "http-headers": json.dumps(http, ensure_ascii=False),
        "coding-not-undone": field(http, "Content-Encoding") if raw is None else "", "title": title_of(page) if kind in PAGE_TYPES else "", "html-lang": read.lang, "payload-length": str(len(body)),
    }
    lines = [f"{k}: {v}" for k, v in facts.items() if v] + [f"outlink: {x}" for x in read.outlinks]
    shared = {"WARC-Refers-To": source, "WARC-Target-URI": field(headers, "WARC-Target-URI"), "WARC-Date": field(headers, "WARC-Date") or UNDATED, "WARC-IP-Address": field(headers, "WARC-IP-Address"), "WARC-Warcinfo-ID": field(headers, "WARC-Warcinfo-ID"), "WARC-Truncated": truncated}
    out = []
    for name, mime, made in (("metadata", "application/warc-fields", ("\r\n".join(re.sub(r"[\r\n]+", " ", x) for x in lines) + "\r\n").encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        fields = {"WARC-Type": name, "WARC-Record-ID": record_id(name, source, made), **shared, "WARC-Source-Payload-Digest": payload, "Content-Type": mime}
        out.append((headers_of(fields, made), made))
    return out


def _response(url: str, page: str, date: str) -> tuple[dict[str, str], bytes]:
    body = page.encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", url, block), "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response"}
    return headers_of(fields, block), block


def responses(pages: DataFrame, date: str = UNDATED) -> DataFrame:
    """page_id, headers (JSON object) and block of a response record for every page. Null urls and html count as empty; repeated pages give equal records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            made = [_response(url or "", page or "", date) for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True)]
            yield pa.record_batch({"page_id": batch["page_id"], "headers": pa.array([json.dumps(h) for h, _ in made], pa.string()), "block": pa.array([b for _, b in made], pa.binary())})

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, headers string, block binary")


def _headers(text: str | None) -> dict[str, str]:
    """The fields of a JSON object; none of what isn't one."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return {k: v if isinstance(v, str) else "" if v is None else json.dumps(v) for k, v in found.items()} if isinstance(found, dict) else {}


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for every response record of (key, headers as a JSON object, block): key, warc_type, record_id, refers_to, target_uri, content_type,
    source_digest (of the response's payload), headers, block.

    Other record types are passed over. A record without an id gets one from its content; null headers or blocks, and headers that aren't a JSON object,
    count as empty, and a record without a type is a response. Chunked, gzip, deflate and zstd bodies are unpacked; other codings, and types that
    aren't text, give an empty conversion record. Unknown charsets count as UTF-8. Repeated records give repeated rows with equal ids. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "block"):
            rows = []
            for k, head, block in zip(*[batch[c].to_pylist() for c in (key, "headers", "block")], strict=True):
                headers = _headers(head)
                if (field(headers, "WARC-Type") or "response").lower() == "response":
                    rows += [(k, h, raw) for h, raw in derivatives(headers, block or b"")]
            names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "content_type": "Content-Type", "source_digest": "WARC-Source-Payload-Digest"}
            yield pa.record_batch({
                key: pa.array([k for k, _, _ in rows], batch[key].type),
                **{c: pa.array([field(h, name) for _, h, _ in rows], pa.string()) for c, name in names.items()},
                "headers": pa.array([json.dumps(h) for _, h, _ in rows], pa.string()),
                "block": pa.array([raw for _, _, raw in rows], pa.binary()),
            })

    records = only(records, key, "headers", "block")
    schema = f"`{key}` {dict(records.dtypes)[key]}, warc_type string, record_id string, refers_to string, target_uri string, content_type string, source_digest string, headers string, block binary"
    return records.mapInArrow(run, schema)


def read_warc(files: DataFrame) -> DataFrame:
    """path, position, headers, block of all records of files (path, content), as spark.read.format("binaryFile") gives them (files of up to 2 GB).

    Records leave in small batches: beside the file itself a task holds few of them. Null contents and files that are no archive have no records.
    """

    def table(path: str, rows: list) -> pa.RecordBatch:
        return pa.record_batch({"path": pa.array([path] * len(rows), pa.string()), "position": pa.array([r[0] for r in rows], pa.int64()), "headers": pa.array([json.dumps(r[1]) for r in rows], pa.string()), "block": pa.array([r[2] for r in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "content"):
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows, size = [], 0
                for i, (headers, block) in enumerate(parse(data.as_buffer() if data.is_valid else b"")):
                    rows.append((i, headers, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield table(path, rows)
                        rows, size = [], 0
                yield table(path, rows)

    return only(files, "path", "content").mapInArrow(run, "path string, position long, headers string, block binary")
