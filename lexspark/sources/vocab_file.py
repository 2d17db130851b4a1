"""The binary vocabulary file: reader, writer, header scan, and a Spark data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..functions import capcode as cap
from ..operators.vocab import Entry, Vocab, order_key


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def u24(self) -> int:
        return int.from_bytes(self.take(3), "little")

    def f32(self) -> float:
        return struct.unpack("<f", self.take(4))[0]

    def short(self) -> bytes:
        return self.take(self.u8())


def loads(data: bytes) -> Vocab:
    """Parse a vocabulary. Entries must be in dictionary order and nothing may follow the deleted list."""
    r = _Reader(data)
    v = Vocab(capcode=r.u8(), charset=r.u8(), norm=r.u8(), level=r.u8(), reserve=r.u8())
    r.take(3)
    none = lambda x: None if x == S.NONE else x
    unk, _size, _reverse, n, delete = (r.u24() for _ in range(5))
    v.unk, v.delete_id, v.max_len = none(unk), none(delete), r.u8()
    for _ in range(n):
        token, flag, words, a, b, i, score = r.short(), r.u8(), r.u8(), r.u24(), r.u24(), r.u24(), r.f32()
        if not 0 < len(token) <= S.MAX_TOKEN:
            raise ValueError("a token is empty or too long")
        v.entries.append(Entry(token, i, max(0.0, score), flag, words, none(a), 0, none(b), 0, score < -0.5))
    tokens = [e.token for e in v.entries]
    if tokens != sorted(tokens, key=order_key):
        raise ValueError("entries are not in dictionary order")
    for e in v.entries:
        e.alt_len = len(tokens[e.alt]) if e.alt is not None else 0
        e.alt2_len = len(tokens[e.alt2]) if e.alt2 is not None else 0
    v.begin = r.take(256)
    for _ in range(r.u24()):
        v.deleted.append((r.short(), none(r.u24()), r.f32()))
    if r.at != len(data):
        raise ValueError("data after the end")
    return v


def dumps(v: Vocab) -> bytes:
    """The file of a vocabulary; an alternative must stand before its token."""
    u24 = lambda x: (S.NONE if x is None else x).to_bytes(3, "little")
    out = [bytes([v.capcode, v.charset, v.norm, v.level, v.reserve, 0, 0, 0]), u24(v.unk), u24(len(v)), u24(v.highest_id + 1), u24(len(v.entries)), u24(v.delete_id), bytes([v.max_len])]
    for k, e in enumerate(v.entries):
        if (e.alt or 0) > k or (e.alt2 or 0) > k:
            raise ValueError("an alternative comes after its token")
        out += [bytes([len(e.token)]), e.token, bytes([e.flag, e.n_words]), u24(e.alt), u24(e.alt2), u24(e.id), struct.pack("<f", -1.0 if e.dup else e.score)]
    out += [bytes(v.begin), u24(len(v.deleted))]
    for t, i, s in v.deleted:
        out += [bytes([len(t)]), t, u24(i), struct.pack("<f", s)]
    return b"".join(out)


def load(spark: SparkSession, path: str) -> Vocab:
    """Read one file from any store that Spark reads. A vocabulary has a bounded size."""
    return loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def save(v: Vocab, path: str) -> None:
    with open(path, "wb") as f:
        f.write(dumps(v))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its first fields, read without parsing the tokens."""
    u = lambda at, n: sum((F.conv(F.hex(F.substring("content", at + k, 1)), 16, 10).cast("int") * (1 << (8 * k)) for k in range(1, n)), F.conv(F.hex(F.substring("content", at, 1)), 16, 10).cast("int"))
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", u(1, 1).alias("capcode"), u(2, 1).alias("charset"), u(3, 1).alias("norm_flags"), u(4, 1).alias("level"), u(5, 1).alias("reserve"), F.nullif(u(9, 3), F.lit(S.NONE)).alias("unk_id"), u(12, 3).alias("vocab_size"), u(15, 3).alias("n_reverse"))


class VocabSource(DataSource):
    """spark.read.format("lexvocab").load(path): the tokens of a vocabulary file as vocab_info rows."""

    @classmethod
    def name(cls) -> str:
        return "lexvocab"

    def schema(self):
        return S.VOCAB_INFO

    def reader(self, schema) -> DataSourceReader:
        return _VocabReader(self.options["path"])


class _VocabReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            v = loads(f.read())
        for i, t, d, k, s in v.info():
            yield i, bytearray(t), bytearray(d), k, float(s)


__all__ = ["VocabSource", "cap", "dumps", "headers", "load", "loads", "save"]
