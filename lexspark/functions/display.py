"""How tokens are written: charsets, display strings, YAML strings and the hex form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NORM_FLAGS

#: Any name may stand before "HexEncode"; files of other writers put theirs there.
HEX = re.compile(r"^\w*HexEncode\{([0-9A-Fa-f]*)\}$")
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", "\a": "\\a", "\b": "\\b", "\f": "\\f"}


def from_text(s: str, charset: int) -> bytes:
    return s.encode({1: "utf-8", 2: "utf-16-le"}.get(charset, "latin-1"), "replace")


def to_text(b: bytes, charset: int) -> str:
    return b.decode({1: "utf-8", 2: "utf-16-le"}.get(charset, "latin-1"), "replace")


def write_token(b: bytes) -> str:
    """A YAML double-quoted string; tokens that are not UTF-8 or hold control characters in the hex form."""
    try:
        s = b.decode()
    except UnicodeDecodeError:
        return f'"HexEncode{{{b.hex()}}}"'
    if any(ord(c) < 32 and c not in _ESCAPES for c in s) or "\x7f" in s or "�" in s:
        return f'"HexEncode{{{b.hex()}}}"'
    return '"' + "".join(_ESCAPES.get(c, c) for c in s) + '"'


def read_token(s: str) -> bytes:
    m = HEX.match(s)
    return bytes.fromhex(m[1]) if m else s.encode()


def unescape(s: str) -> str:
    back = {v[1]: k for k, v in _ESCAPES.items()}
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "xu" and len(m[1]) > 1 else back.get(m[1], m[1]), s)


def hex_form_col(token: Column) -> Column:
    """Token as text, or in the hex form where it is not UTF-8."""
    return F.when(F.is_valid_utf8(token.cast("string")), token.cast("string")).otherwise(F.concat(F.lit("HexEncode{"), F.lower(F.hex(token)), F.lit("}")))


def display_col(token: Column) -> Column:
    """Control characters, HTML and marks made visible."""
    c = token
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "CWD", "⇧⇪⌫")


def norm_names_col(flags: Column) -> Column:
    """Flags as a list of names."""
    return F.array_join(F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(v)) != 0, F.lit(k)) for k, v in NORM_FLAGS.items()])), " ")
