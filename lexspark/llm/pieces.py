"""SentencePiece encoding and decoding through a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

MARK = "▁"
#: Beyond this many chunks the table of a task keeps only those in use; longer chunks are segmented where they stand.
MOST_CHUNKS, LONGEST_CHUNK = 400_000, 96
_CHUNK = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Segments each distinct marked word once.

    A chunk is a run of spaces and the non-spaces after it. When no piece holds a whitespace marker after
    another character, no merge can cross from one chunk to the next, so the ids of a text are the ids of
    its chunks in order. `separable` says whether that holds for the model; if not, or where the
    normaliser changes a chunk by more than its spaces, whole texts go to the library.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bos, self.eos, self.mark = sp.bos_id(), sp.eos_id(), sp.piece_to_id(MARK)
        self.separable = sp.normalize("a  b ") == f"{MARK}a{MARK}{MARK}b{MARK}" and not any(
            MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size())
        )
        self.lead = next((i for i in range(sp.vocab_size()) if sp.id_to_piece(i) == "a"), None)
        self.separable = self.separable and sys.byteorder == "little" and array("I").itemsize == 4 and self.lead is not None and self.mark != sp.unk_id()
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunk: str) -> tuple[bytes, str] | None:
        rest = chunk[1:]
        if rest and self.sp.normalize(rest) != chunk.replace(" ", MARK):
            return None
        ids = self.sp.encode(rest) if rest else [self.mark]
        return np.array(ids, dtype="<u4").tobytes(), self.sp.decode([self.lead, *ids])[1:]

    def lookup(self, chunk: str) -> tuple[bytes, str] | None:
        known = self.chunks.get(chunk)
        if known is None:
            known = self._segment(chunk)
            if known is not None and len(chunk) <= LONGEST_CHUNK:
                if len(self.chunks) >= MOST_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = known
        return known

    def learn(self, texts: list[str]) -> None:
        """Segment the new chunks of several texts in one call of the library each way."""
        if not self.separable:
            return
        met: set[str] = set()
        for t in texts:
            met.update(_CHUNK.findall(" " + t.replace(MARK, " ")))
        new = [c for c in met if c not in self.chunks and 1 < len(c) <= LONGEST_CHUNK]
        if len(self.chunks) + len(new) > MOST_CHUNKS:  # what these texts use stays
            self.chunks = {c: self.chunks[c] for c in met if c in self.chunks}
        rest = [c[1:] for c in new[:MOST_CHUNKS]]
        joined = "".join(rest)
        if joined and self.sp.normalize(joined) == MARK + joined.replace(" ", MARK):
            ids = self.sp.encode(rest, num_threads=1)
            back = self.sp.decode([[self.lead, *i] for i in ids], num_threads=1)
            self.chunks.update((c, (array("I", i).tobytes(), c if c == d[1:] else d[1:])) for c, i, d in zip(new, ids, back, strict=False))

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids without begin and end as little-endian u32, the decoded text)."""
        if not text:
            return b"", ""
        if self.separable:
            get, look = self.chunks.get, self.lookup
            found = [get(c) or look(c) for c in _CHUNK.findall(" " + text.replace(MARK, " "))]
            if None not in found:
                ids = b"".join([f[0] for f in found])
                return ids, "".join([f[1] for f in found])[1:]  # the dummy prefix is not part of the text
        ids = self.sp.encode(text)
        return np.array(ids, dtype="<u4").tobytes(), self.sp.decode(ids)


@lru_cache(maxsize=2)
def _table(model: str) -> ChunkTable:
    return ChunkTable(model)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", model: str | None = None, ends: bool = True) -> DataFrame:
    """docs plus the column `ids` (array<int>): exactly the library's ids, with begin and end ids if `ends`.

    One narrow pass without a shuffle: each task keeps a table of the distinct chunks it has met, segments
    a new one once and joins the ids back by position. Null and empty texts give no ids but the ends.
    """
    model = model or default_model()
    out = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(model)
        b, e = np.array([t.bos], dtype="<u4").tobytes(), np.array([t.eos], dtype="<u4").tobytes()
        for batch in batches:
            for part in _slices(batch, text):
                texts = _texts(part, text)
                t.learn(texts)
                packed = [b + t.encode(x)[0] + e if ends else t.encode(x)[0] for x in texts]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, out)


def _slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, so long texts do not add up."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)) if len(col) else np.zeros(0)
    cut, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield batch.slice(cut, i + 1 - cut)
            cut, total = i + 1, 0
    if cut < batch.num_rows:
        yield batch.slice(cut)


def decode(tokens: DataFrame, ids: str = "token_ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """tokens plus the column `text`: the library's decode(ids). Null ids give null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def run(col):
        import pandas as pd

        sp = _table(model).sp
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in col], dtype=object)

    return tokens.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, begin and end ids included."""
    model = model or default_model()
    field = docs.schema[id_col]
    out = T.StructType([field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(model)
        b, e = np.array([t.bos], dtype="<u4").tobytes(), np.array([t.eos], dtype="<u4").tobytes()
        for batch in batches:
            for part in _slices(batch, column):
                n, a, d, texts = [], [], [], _texts(part, column)
                t.learn(texts)
                for x in texts:
                    ids, back = t.encode(x)
                    n.append(len(ids) // 4 + 2)
                    a.append(hashlib.sha256(b + ids + e).hexdigest())
                    d.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=out.names)

    column = fresh(docs, "__lx_text")
    return docs.select(id_col, F.col(text).alias(column)).mapInArrow(run, out)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
