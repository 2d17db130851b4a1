"""Character classes over Unicode categories, and runes of byte strings."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAR_MARK, WORD_MARK, DELETE_MARK, PLAIN_DELETE = "C", "W", "D", "\x7f"
APOSTROPHES = ("'", "’")
PAIRS = dict(zip("([{'\"‘“«‹‛`„″〝「『｢〈《‟❛❝❮〔⸨", ")]}'\"’”»›’`”″〞」』｣〉》”❜❞❯〕⸩", strict=True))
DELIMITERS = frozenset("()[]{}'\"‘’“”«»‹›‛`„″〝〞「」『』｢｣〈〉《》‟❛❜❝❞❮❯〔〕⸨⸩")
DELIMITERS_WIDE = DELIMITERS | {"<", ">"}
BAD = "�"


@lru_cache(maxsize=1 << 16)
def category(r: str) -> str:
    return unicodedata.category(r) if r else ""


def is_mark(r: str, capcode: int) -> bool:
    """A capcode mark of that level."""
    return (capcode == 2 and r in (CHAR_MARK, WORD_MARK, DELETE_MARK)) or (capcode == 1 and r == PLAIN_DELETE)


def is_letter(r: str, capcode: int = 0) -> bool:
    c = category(r)
    return (c[:1] == "L" and not (capcode == 2 and r in "CWD")) or c[:1] == "M"


def is_number(r: str) -> bool:
    return category(r)[:1] == "N"


def is_alnum(r: str, capcode: int = 0) -> bool:
    return is_letter(r, capcode) or is_number(r)


def is_space(r: str) -> bool:
    return r in ("\t", "\n", "\v", "\f", "\r", " ", "\x85", "\xa0") or category(r)[:1] == "Z"


def runes(b: bytes) -> list[tuple[str, int]]:
    """(character, bytes) of a byte string; a byte that is not valid UTF-8 is one bad rune of length 1."""
    s = b.decode("utf-8", "surrogateescape")
    return [(c, 1) if c < "\x80" else (BAD, 1) if "\udc80" <= c <= "\udcff" else (c, len(c.encode())) for c in s]


def incomplete_tail(b: bytes) -> int:
    """Number of bytes of an unfinished UTF-8 character at the end."""
    for back in range(1, min(4, len(b) + 1)):
        c = b[-back]
        if c & 0xC0 == 0x80:
            continue
        need = 4 if c >= 0xF0 else 3 if c >= 0xE0 else 2 if c >= 0xC0 else 1
        return back if back < need else 0
    return 0


def incomplete_tail_utf16(b: bytes) -> int:
    """The same for UTF-16LE: an odd byte, or a high surrogate whose pair is missing."""
    odd = len(b) % 2
    even = b[: len(b) - odd]
    high = len(even) >= 2 and 0xD8 <= even[-1] <= 0xDB
    return odd + 2 * high


def can_have_unk(single_bytes: int, capcode: int) -> bool:
    """False where every byte that can occur has a token."""
    return single_bytes < (233 if capcode == 2 else 256)


# ---- the same classes as Column expressions ----------------------------------------------------------


def has_letter_col(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{M}]")


def only_latin_col(c: Column) -> Column:
    """No letter of another script."""
    return ~c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def strip_non_latin_col(c: Column) -> Column:
    """Letters of other scripts and replacement characters removed."""
    return F.regexp_replace(c, r"[\p{L}&&[^\p{IsLatin}]]|\x{FFFD}", "")


def valid_col(b: Column) -> Column:
    """Whether a binary column holds valid UTF-8."""
    return F.is_valid_utf8(b.cast("string"))


def possessive_cut_col(c: Column) -> Column:
    """Position of a trailing 's after a letter, else -1."""
    return F.when(c.rlike(r"[\p{L}\p{M}]['’]s$"), F.length(c) - 2).otherwise(F.lit(-1))


def prebuilt_name_col(c: Column) -> Column:
    """Names like english-32000-balanced-v1."""
    return c.rlike(r"^(english|englishcode|code|fiction)-\d+-(unfiltered|clean|balanced|consistent|strict)(-nocapcode)?-v\d+$")


def size_in_bytes(text: str) -> int:
    """'10MB' -> 10,000,000; suffixes are powers of 1000."""
    t = text.strip().upper().removesuffix("B")
    unit = {"K": 1, "M": 2, "G": 3, "T": 4}.get(t[-1:], 0)
    return int(float(t[: -1 if unit else None]) * 1000**unit)
