"""The compressed token file: tokens, optional scores, optional special tokens."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.vocab import Vocab

SCHEMA = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("score", T.FloatType()), T.StructField("is_special", T.BooleanType())])


@dataclass
class TokenFile:
    capcode: int = 0
    charset: int = 1
    norm: int = 0
    level: int = 0
    reserve: int = 0
    tokens: list[bytes] = field(default_factory=list)
    scores: list[float] | None = None
    special: list[bytes] = field(default_factory=list)


def dumps(t: TokenFile) -> bytes:
    """Single bytes come first, as the miner writes them; scores move with their tokens."""
    at = sorted(range(len(t.tokens)), key=lambda i: len(t.tokens[i]) != 1)
    out = [bytes([t.capcode, t.charset, t.norm, t.level, t.reserve, 0, 0, 0]), struct.pack("<Q", len(at))]
    out += [bytes([len(t.tokens[i])]) + t.tokens[i] for i in at]
    if t.scores is not None or t.special:
        scores = t.scores or [0.0] * len(at)
        out.append(struct.pack(f"<{len(at)}f", *[scores[i] for i in at]))
    if t.special:
        out.append(struct.pack("<I", len(t.special)))
        out += [bytes([len(s)]) + s for s in t.special]
    return zlib.compress(b"".join(out))


def loads(data: bytes) -> TokenFile:
    """Optional sections are told by whether bytes are left."""
    b = zlib.decompress(data)
    t, at = TokenFile(*b[:5]), 16

    def short() -> bytes:
        nonlocal at
        n = b[at]
        if at + 1 + n > len(b):
            raise ValueError("the file ends early")
        at += 1 + n
        return b[at - n : at]

    (n,) = struct.unpack_from("<Q", b, 8)
    t.tokens = [short() for _ in range(n)]
    if at < len(b):
        t.scores = list(struct.unpack_from(f"<{n}f", b, at))
        at += 4 * n
    if at < len(b):
        (m,) = struct.unpack_from("<I", b, at)
        at += 4
        t.special = [short() for _ in range(m)]
    if at != len(b):
        raise ValueError("data after the end")
    return t


def read(spark: SparkSession, path: str) -> DataFrame:
    """(token, score, is_special) of a file."""
    t = loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    rows = [(bytearray(x), s, False) for x, s in zip(t.tokens, t.scores or [None] * len(t.tokens), strict=True)] + [(bytearray(x), None, True) for x in t.special]
    return spark.createDataFrame(rows, SCHEMA)


def of_vocab(v: Vocab) -> TokenFile:
    """The token file of a vocabulary: what it would be built from."""
    plain = [e for e in v.entries if not e.dup]
    regular = [e for e in plain if not e.flag & 64]
    return TokenFile(v.capcode, v.charset, v.norm, v.level, v.reserve, [e.token for e in regular], [e.score for e in regular], [e.token for e in plain if e.flag & 64])


def to_vocab(t: TokenFile, unk: bool = False) -> Vocab:
    scores = dict(zip(t.tokens, t.scores, strict=True)) if t.scores else None
    return Vocab.new(t.tokens, t.special, capcode=t.capcode, charset=t.charset, normalization=t.norm, reserve=t.reserve, unk=unk, scores=scores, level=t.level, special_encoded=True)


_RESULT = re.compile(r"^(\d+)_\d+\.[A-Za-z0-9]+$")


def result_score(name: str) -> int | None:
    """Score of a finished training result, from its file name."""
    m = _RESULT.match(name)
    return int(m[1]) if m else None


def best_result(spark: SparkSession, folder: str) -> str | None:
    """The result file with the smallest score, compared as a number."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"/(\d+)_\d+\.[A-Za-z0-9]+$", 1).alias("score"))
    return files.where("score <> ''").agg(F.min_by("path", F.col("score").cast("long"))).first()[0]


def near_best(results: DataFrame, score: str = "score") -> DataFrame:
    """Results within one percent of the best."""
    best = results.agg(F.min(score).alias("__best"))
    return results.crossJoin(F.broadcast(best)).where(F.col(score) <= F.col("__best") + F.col("__best") / 100).drop("__best")  # one row


class TokenSource(DataSource):
    """spark.read.format("lextok").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "lextok"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options["path"])


class _TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            t = loads(f.read())
        for x, s in zip(t.tokens, t.scores or [None] * len(t.tokens), strict=True):
            yield bytearray(x), s, False
        for x in t.special:
            yield bytearray(x), None, True
