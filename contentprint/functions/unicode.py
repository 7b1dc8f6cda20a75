"""What needs Unicode tables that the JVM side lacks: Arrow UDFs over whole columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F

from ..errors import BadInputError, UnsupportedError

FORMS = ("nfc", "nfkc", "none")
# The bidirectional controls.
BIDI = dict.fromkeys([0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)])
# Letters of other scripts that look like Latin ones (a common subset of the confusables table).
CONFUSABLE = str.maketrans("аеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhlABEZHIKMNOPTYXABEKMHOPCTYXIJS")

WORD = regex.compile(r"(?V1w)\b")
GRAPHEME = regex.compile(r"\X")


def canonical(text: str, form: str = "nfkc", casefold: bool = True, strip_bidi: bool = True, strip_format: bool = True, confusables: bool = False) -> str:
    """Normal form, then simple case folding, then without bidirectional controls and other format characters."""
    if form not in FORMS:
        raise BadInputError(f"normal form {form!r}")
    if text.isascii():
        return text.lower() if casefold else text
    if form != "none":
        text = unicodedata.normalize(form.upper(), text)
    if casefold:
        text = "".join(c if len(low := c.lower()) != 1 else low for c in text)
    if strip_bidi:
        text = text.translate(BIDI)
    if strip_format:
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return text.translate(CONFUSABLE) if confusables else text


def words(text: str) -> list[str]:
    """Words between default word boundaries that hold a letter or digit."""
    return [w for w in WORD.split(text) if any(c.isalnum() for c in w)]


def graphemes(text: str) -> list[str]:
    return GRAPHEME.findall(text)


def tokenizer(name: str):
    if name == "word":
        return words
    if name == "grapheme":
        return graphemes
    if name in ("cjk-jp", "cjk-ko"):
        raise UnsupportedError(f"tokenizer {name} needs a dictionary that isn't installed")
    raise BadInputError(f"tokenizer {name!r}")


def canonicalize(**options):
    """A column function; null stays null."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else canonical(t, **options))

    return run


def tokenize(name: str = "word", **options):
    split = tokenizer(name)

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: split(canonical(t or "", **options)))

    return run


def config_tag(k: int, name: str, **options) -> str:
    return f"{name}:k={k}:" + ",".join(f"{a}={b}" for a, b in sorted(options.items()))
