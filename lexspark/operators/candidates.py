"""Candidate mining: byte n-grams of a corpus with their counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import runes
from ..functions.normalize import to_model
from ..schema import MAX_TOKEN, NORM_FLAGS
from .filters import Filter

#: Distinct n-grams a task counts before it hands its counts to the shuffle.
COMBINE = 400_000


def check_options(mode: str, capcode: int, charset: int, norm: int, only_valid: bool = False) -> None:
    if charset == 2:
        raise ValueError("candidates are mined from UTF-8 or raw text only")
    if capcode == 2 and norm & NORM_FLAGS["lowercase"]:
        raise ValueError("lowercase and capcode 2 exclude each other")
    if not charset and (norm & NORM_FLAGS["nfd"] or only_valid):
        raise ValueError("NFD and only-valid need a charset")
    Filter(mode, capcode)


def mine(docs: DataFrame, text: str = "text", *, low: int = 2, high: int = MAX_TOKEN, mode: str = "unfiltered", capcode: int = 0, norm: int = 0, words: int = 0,
         min_occur: int | None = None, only_latin: bool = False, only_valid: bool = False, charset: int = 1) -> DataFrame:
    """candidates(token binary, n bigint): every window of low..high bytes that passes the mode filter.

    Counts are exact and windows do not cross documents. Each task counts in a table of at most COMBINE
    n-grams and passes it on when it is full: a partial aggregation before the only shuffle, which is by
    token. min_occur defaults to one in ten million corpus bytes. Filters on the final tokens run after
    counting, on distinct tokens.
    """
    check_options(mode, capcode, charset, norm, only_valid)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, memo = Filter(mode, capcode, words), {}
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(0):
                b = to_model((x.as_py() or "").encode(), norm, capcode)
                if mode == "unfiltered":
                    for i in range(len(b) - low + 1):
                        counts.update([b[i:j] for j in range(i + low, min(i + high, len(b)) + 1)])
                        if len(counts) > COMBINE:
                            yield flush()
                else:
                    rs = runes(b)
                    ends = [0]
                    for _, n in rs:
                        ends.append(ends[-1] + n)
                    for i in range(len(rs)):
                        for j in range(i + 1, len(rs) + 1):
                            size = ends[j] - ends[i]
                            if size > high:
                                break
                            if size < low:
                                continue
                            ahead = b[ends[j] : ends[j + 1]] if j < len(rs) else b""
                            key = (b[ends[i] : ends[j]], ahead)
                            ok = memo.get(key)
                            if ok is None:
                                if len(memo) > COMBINE:
                                    memo.clear()
                                ok = memo[key] = keep(*key)
                            if ok:
                                counts[key[0]] += 1
                        if len(counts) > COMBINE:
                            yield flush()
        if counts:
            yield flush()

    found = docs.select(text).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    if min_occur is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        min_occur = max(1, size // 10_000_000)
    found = found.where(F.col("n") >= min_occur)
    s = F.col("token").cast("string")
    if only_latin:
        found = found.where(~s.rlike(r"[\p{L}&&[^\p{IsLatin}]]"))
    if only_valid:
        found = found.where(F.is_valid_utf8(s))
    return found


def mine_native(docs: DataFrame, text: str = "text", low: int = 2, high: int = 8, min_occur: int = 1) -> DataFrame:
    """The unfiltered counts as one plan without Python: two explodes and a hash aggregate. For short
    windows; for long ones mine() sends far fewer rows to the shuffle."""
    b = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    at = docs.select(b.alias("b")).where(F.length("b") >= low).select("b", F.explode(F.sequence(F.lit(1), F.length("b") - low + 1)).alias("i"))
    grams = at.select(F.explode(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length("b") - F.col("i") + 1)), lambda n: F.substring(F.col("b"), F.col("i"), n))).alias("token"))
    return grams.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_occur)


def byte_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """(byte, n): counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                total.update((x.as_py() or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["byte", "n"])

    return docs.select(text).mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


EXTRA_CODE = ["#define", "#include", "std::", "printf(", "return", "function", "const ", "public ", "private ", "import ", "def ", "self.", "</div>", "<div>", "<span>", "</span>", "<p>", "</p>", "<br>", "http://", "https://", "www.", ".com", ".org", ".net", "();", "{}", "[]", "=>", "!=", "==", "&&", "||"]


def extra_tokens(capcode: int = 0, norm: int = 0) -> list[bytes]:
    """Code and markup tokens, each alone and after a space; tokens that end in '/' also before a delete mark."""
    out: set[bytes] = set()
    for v in EXTRA_CODE:
        for t in (v, " " + v, *([v + "D"] if v.endswith("/") and capcode == 2 else [])):
            out.add(to_model(t.encode(), norm, capcode) if not t.endswith("D") else to_model(t[:-1].encode(), norm, capcode) + b"D")
    return sorted(t for t in out if 2 <= len(t) <= MAX_TOKEN)
