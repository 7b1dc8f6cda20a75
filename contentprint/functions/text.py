"""Text expressions: tokens, shingles, markup, identifiers. All run in the JVM but for those that say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Stretches of letters and digits; split first, then lower-cased, as one letter may become two code points."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), F.lower)


def shingles(words: Column, k: int) -> Column:
    """Runs of k words joined by a blank; all words as one if there are fewer; none without words."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def html_text(html: Column) -> Column:
    """Tags, comments, scripts and styles go; the five named references are decoded; white space is one blank."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0b]+", " "))


#: Patterns and what they become, applied in this order.
MARKDOWN = (
    (r"(?s)```.*?```", " "),
    (r"`([^`]*)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]*#{1,6}[ \t]*", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+", ""),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"__([^_]*)__", "$1"),
    (r"~~([^~]*)~~", "$1"),
)


def markdown_text(text: Column) -> Column:
    for pattern, out in MARKDOWN:
        text = F.regexp_replace(text, pattern, out)
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def modality(mime: Column, name: Column) -> Column:
    """text, image or audio by MIME type, else by extension; null if neither tells."""
    extension = F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)))
    by_mime = F.when(mime.rlike("^image/"), "image").when(mime.rlike("^audio/"), "audio").when(mime.rlike("^text/|json|xml"), "text")
    by_name = (
        F.when(extension.isin("png", "jpg", "jpeg", "webp", "gif", "bmp"), "image")
        .when(extension.isin("wav", "mp3", "flac", "ogg", "m4a", "pcm", "f32"), "audio")
        .when(extension.isin("txt", "md", "markdown", "html", "htm", "csv", "json", "xml"), "text")
    )
    return F.coalesce(by_mime, by_name)


def bearer(authorization: Column, x_api_key: Column) -> Column:
    """The presented token: what follows 'Bearer ', else the X-Api-Key header; null if blank."""
    token = F.nullif(F.trim(F.when(authorization.startswith("Bearer "), F.substring(authorization, 8, 1_000_000))), F.lit(""))
    return F.coalesce(token, F.nullif(F.trim(x_api_key), F.lit("")))


def time_id(ms: Column, low: Column) -> Column:
    """A 63-bit id: milliseconds since 2024-01-01 above 22 low bits."""
    return F.shiftleft(ms - 1_704_067_200_000, 22).bitwiseOR(low.bitwiseAND(F.lit((1 << 22) - 1)))


def url_safe_base64(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def truncated(text: Column, most_bytes: int) -> Column:
    """At most most_bytes bytes of UTF-8, cut between characters, with an ellipsis if anything was cut."""
    raw = F.encode(text, "UTF-8")
    at = F.lit(most_bytes)
    for _ in range(3):  # a character has at most three continuation bytes; step back over them
        following = F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
        at = F.when(following.between(128, 191), at - 1).otherwise(at)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"), F.lit("…")))


#: Crockford's digits. Fixed value.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: Column, seed: Column) -> Column:
    """A 26-digit sortable id: 48 bits of time, and 80 bits from the MD5 of `seed`, so that a repeated task gives the same one."""
    def digits(number: Column, n: int) -> list[Column]:
        return [F.substring(F.lit(BASE32), F.shiftrightunsigned(number, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(n - 1, -1, -1)]

    half = lambda first: F.conv(F.substring(F.md5(seed), first, 10), 16, 10).cast("long")
    return F.concat(*digits(ms.cast("long"), 10), *digits(half(1), 8), *digits(half(11), 8))
