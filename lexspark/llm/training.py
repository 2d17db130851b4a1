"""Bounded training samples and scoring passes shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textmodel import RowFile

#: Labelled documents that a classifier is fitted on at most, taken by the order of a hash of their id.
SAMPLE = 6000
#: Pieces in which the features of the sample come to the driver.
PIECES = 32


def held_out(id_col: str):
    """True where crc32 of the id as text leaves 2 modulo 4; these labels are never read. A null id: false."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable, id_col: str = "doc_id", text: str = "text", most: int = SAMPLE, twin: Callable | None = None):
    """(labels, Rows, twins) of the training sample, on the driver, where the features lie in temporary files.

    At most `most` labelled ids, so the ids are broadcast and texts are not shuffled; features are computed
    on the executors and come in PIECES, of which the driver holds one at a time. Null labels and ids are left out;
    of several labels of an id the largest holds.
    twin: the features of a text that is changed somehow, or null. Twins are (the rows that have one, their Rows).
    """
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(id_col).alias("__lx_id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("__lx_id")).select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda parts, i: pa.array([p and p[i].tobytes() for p in parts], pa.binary())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                got, twins = [], []
                for t in batch.column(2):
                    t = t.as_py()
                    got.append(features(t))
                    twins.append(twin(t) if twin else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(got, 0), pack(got, 1), pack(twins, 0), pack(twins, 1)], names=["id", "y", "slots", "values", "twin_slots", "twin_values"])

    got = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, slots binary, values binary, twin_slots binary, twin_values binary")
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("slots", "values")]
    got = got.orderBy(*order).limit(most).repartitionByRange(PIECES, *order).sortWithinPartitions(*order).drop("id")
    y, own, has, twins = [], RowFile(), [], RowFile()
    for r in got.toLocalIterator():
        if r.twin_slots is not None:
            has.append(len(y))
            twins.add(np.frombuffer(r.twin_slots, np.int32), np.frombuffer(r.twin_values, np.float32))
        own.add(np.frombuffer(r.slots, np.int32), np.frombuffer(r.values, np.float32))
        y.append(r.y)
    return np.array(y, dtype=np.int64), own.rows(), (has, twins.rows())
