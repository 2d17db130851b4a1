"""Text normalisation: Column builders, the NFD function, and the same rules for single strings."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NORM_FLAGS
from . import capcode as cap

_QUOTES = str.maketrans("‘’“”", "''\"\"")


@F.pandas_udf(T.StringType())
def nfd(col: pd.Series) -> pd.Series:
    """Canonical decomposition; ASCII strings pass as they are."""
    return col.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x))


def newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def quotemarks(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def leading_space(c: Column) -> Column:
    return F.when((F.length(c) > 0) & ~c.startswith(" "), F.concat(F.lit(" "), c)).otherwise(c)


def accents(c: Column) -> Column:
    return F.regexp_replace(nfd(c), r"\p{Mn}", "")


def normalize(c: Column, flags: int) -> Column:
    """One expression in the fixed order: newlines, quotes, collapse, trim, leading space, accents, lower case, NFD."""
    steps = [("newlines", newlines), ("quotemarks", quotemarks), ("collapse", collapse), ("trim", trim), ("leadingspace", leading_space), ("accents", accents), ("lowercase", F.lower)]
    for name, step in steps:
        if flags & NORM_FLAGS[name]:
            c = step(c)
    return nfd(c) if flags & NORM_FLAGS["nfd"] and not flags & NORM_FLAGS["accents"] else c


def normalize_text(s: str, flags: int) -> str:
    """The same for one string."""
    on = lambda name: flags & NORM_FLAGS[name]
    if on("newlines"):
        s = s.replace("\r\n", "\n")
    if on("quotemarks"):
        s = s.translate(_QUOTES)
    if on("collapse"):
        s = re.sub(" {2,}", " ", s)
    if on("trim"):
        s = s.strip("".join(map(chr, range(33))))
    if on("leadingspace") and s and s[0] != " ":
        s = " " + s
    if on("accents"):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    if on("lowercase"):
        s = s.lower()
    return unicodedata.normalize("NFD", s) if on("nfd") and not on("accents") else s


def to_model(data: bytes, flags: int, level: int) -> bytes:
    """Normalised and capcoded bytes: what a vocabulary sees."""
    if not flags and not level:
        return data
    s = normalize_text(data.decode("utf-8", "surrogateescape"), flags)
    return cap.encode(s, level).encode("utf-8", "surrogateescape")


def to_model_once(data: bytes, flags: int, level: int) -> bytes:
    """The same, unless the bytes already hold a capcode mark of that level."""
    marks = b"CWD" if level == 2 else b"\x7f" if level == 1 else b""
    return data if any(m in data for m in marks) else to_model(data, flags, level)


@F.pandas_udf(T.StringType())
def capcode_encode(col: pd.Series) -> pd.Series:
    return col.map(lambda x: None if x is None else cap.encode2(x))


@F.pandas_udf(T.StringType())
def capcode_decode(col: pd.Series) -> pd.Series:
    return col.map(lambda x: None if x is None else cap.Decoder2().decode(x))


def plain_delete_decode(c: Column) -> Column:
    """Level 1 decoding as an expression."""
    return F.regexp_replace(c, r"(?s)\x7F.", "")
