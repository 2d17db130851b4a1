"""Decoding in one shot: as a join with the vocabulary, and as a kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import capcode as cap
from ..functions.charclass import incomplete_tail, incomplete_tail_utf16
from .encode import PART, encoder_of
from .vocab import Vocab


def decode(ids: list[int], vocab: Vocab) -> bytes:
    """Tokens joined and capcode undone; unknown ids are skipped."""
    back = vocab.reverse
    return cap.decode_bytes(b"".join([back.get(i, b"") for i in ids]), vocab.capcode)


class StreamDecoder:
    """Decodes ids that come in parts. Held back between parts: the bytes of an unfinished character and the
    capcode state. The outputs and the flushed rest add up to the one-shot result."""

    def __init__(self, vocab: Vocab, rest: bytes = b"", state: tuple[bool, bool, bool, bool] = (False, False, False, False)):
        self.vocab, self.rest, self.back = vocab, rest, vocab.reverse
        self.capcode = cap.decoder(vocab.capcode if vocab.charset else 0, state)

    def decode(self, ids: list[int]) -> bytes:
        data = self.rest + b"".join([self.back.get(i, b"") for i in ids])
        cut = incomplete_tail(data) if self.vocab.charset == 1 else incomplete_tail_utf16(data) if self.vocab.charset == 2 else 0
        data, self.rest = data[: len(data) - cut], data[len(data) - cut :]
        return self.capcode.decode(data.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")

    def flush(self) -> bytes:
        rest, self.rest = self.rest, b""
        return rest


def texts_of(ids: np.ndarray, ends: np.ndarray, valid: pa.Array, vocab: Vocab) -> pa.Array:
    """The texts of the ids between the ends; null where a row is not valid."""
    back, level = vocab.reverse, vocab.capcode
    one = lambda x: cap.decode_bytes(b"".join([back.get(i, b"") for i in x]), level).decode("utf-8", "replace")
    return pa.array([one(ids[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], valid.to_pylist(), strict=False)], pa.string())


def detokenize_udf(shared: Broadcast):
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return texts_of(np.asarray(col.values), np.asarray(col.offsets), col.is_valid(), shared.value)

    return run


def round_trip(df: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """df with the text encoded and its ids decoded again, in one worker; of a batch, the ids and texts of a part are held."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared)
        for batch in batches:
            done = 0
            for ids, ends, _ in e.texts(batch.column(at), PART):
                part = batch.slice(done, len(ends) - 1)
                done += len(ends) - 1
                yield part.set_column(at, text, texts_of(ids, ends, part.column(at).is_valid(), e.vocab))

    return df.mapInArrow(run, df.schema)


def detokenize_join(df: DataFrame, ids: str, key: str, info: DataFrame) -> DataFrame:
    """(key, bytes as hex): decoding as a join with vocab_info, which is small by construction (< 2^24 rows).

    Rows with equal keys are decoded apart; the order of tokens is their position. Capcode is not undone.
    """
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).withColumn("row", F.monotonically_increasing_id()).select("key", "row", F.posexplode("ids").alias("pos", "id"))
    named = rows.join(info.select("id", F.hex("token").alias("hex")), "id")
    per = named.groupBy("row", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    return per.select(F.col("key").alias(key), F.array_join(F.col("parts.hex"), "").alias("hex"))
