"""Table schemas, code tables and limits of the vocabulary model."""

from __future__ import annotations

from pyspark.sql import types as T

MAX_TOKEN = 40
NONE = (1 << 24) - 1  # "no id" in files; null in tables
CHARSETS = {0: "none", 1: "utf-8", 2: "utf-16"}
LEVELS = {0: "unfiltered", 1: "clean", 2: "balanced", 3: "consistent", 4: "strict", 5: "not trained"}
NORM_FLAGS = {"nfd": 1, "lowercase": 2, "accents": 4, "quotemarks": 8, "collapse": 16, "trim": 32, "leadingspace": 64, "newlines": 128}
RESERVE = {"256": 1, "128": 2, "utf8": 4, "ascii": 8, "extended": 16, "exclude-other": 32}
INFO_TYPES = {0: "regular", 1: "single byte", 2: "special", 3: "unk"}

#: Bits of a token's flag.
ENDS_LETTER, BEGINS_LETTER, BEGINS_SPACE, ENDS_MARK, BEGINS_MARK, WHOLE_WORD, SPECIAL, UNIFORM = (1 << i for i in range(8))
#: Classes of a first byte.
BYTE_LETTER, BYTE_OTHER, BYTE_SPACE = 1, 10, 12

VOCAB_META = T.StructType([
    T.StructField("capcode", T.ByteType()), T.StructField("charset", T.ByteType()), T.StructField("norm_flags", T.ShortType()),
    T.StructField("level", T.ByteType()), T.StructField("reserve", T.ShortType()), T.StructField("unk_id", T.IntegerType()),
    T.StructField("vocab_size", T.IntegerType()), T.StructField("n_reverse", T.IntegerType()), T.StructField("delete_id", T.IntegerType()),
    T.StructField("max_token_length", T.IntegerType()), T.StructField("begin_byte", T.BinaryType()),
])
VOCAB_TOKENS = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("token", T.BinaryType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.FloatType()),
    T.StructField("flag", T.ShortType()), T.StructField("n_words", T.ShortType()),
    T.StructField("alt_idx", T.IntegerType()), T.StructField("alt_len", T.IntegerType()), T.StructField("alt_id", T.IntegerType()),
    T.StructField("alt2_idx", T.IntegerType()), T.StructField("alt2_len", T.IntegerType()), T.StructField("alt2_id", T.IntegerType()),
    T.StructField("is_dup", T.BooleanType()),
])
VOCAB_DELETED = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.FloatType())])
VOCAB_INFO = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("token", T.BinaryType()), T.StructField("token_decoded", T.BinaryType()),
    T.StructField("type", T.ByteType()), T.StructField("score", T.FloatType()),
])
TOKENIZED = "struct<tokens:array<int>,n_tokens:int,missing:int>"


def norm_flags(names: str | int | None) -> int:
    """Flags of a list of normalisation names ('unixlines' and 'newlines' are one)."""
    if names is None or isinstance(names, int):
        return names or 0
    out = 0
    for n in names.lower().split():
        n = {"unixlines": "newlines", "quotes": "quotemarks", "none": ""}.get(n, n)
        if n and n not in NORM_FLAGS:
            raise ValueError(f"unknown normalization {n!r}")
        out |= NORM_FLAGS.get(n, 0)
    return out


def norm_names(flags: int) -> str:
    shown = {"nfd": "NFD", "lowercase": "Lowercase", "accents": "Accents", "quotemarks": "Quotemarks", "collapse": "Collapse", "trim": "Trim", "leadingspace": "LeadingSpace", "newlines": "UnixLines"}
    return " ".join(v for k, v in shown.items() if flags & NORM_FLAGS[k]) or "None"
