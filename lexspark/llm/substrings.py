"""Substring dedup over a compacted De Bruijn graph of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, stored, table

#: Words of a window (an edge of the graph), and of the k-mer whose least hash anchors it.
WINDOW, ANCHOR = 50, 12


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Kernel:
    """Cuts a text into runs of consecutive windows that share an anchor."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor
        self.words = _WordHashes()
        weights = np.full(anchor, self.BASE, np.uint64)
        weights[0] = 1
        self.weights = np.multiply.accumulate(weights)

    def anchors(self, words: list[bytes]) -> np.ndarray:
        """The least k-mer hash of every window. It only says which windows can be equal, so collisions do no harm."""
        x = _mix(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)))
        n = len(words) - self.anchor + 1
        h = np.zeros(n, np.uint64)
        for i, w in enumerate(self.weights):
            h += x[i : i + n] * w
        h = _mix(h)
        view = np.lib.stride_tricks.sliding_window_view(h, self.window - self.anchor + 1)
        return np.concatenate([view[i : i + 32768].min(axis=1) for i in range(0, len(view), 32768)])

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(anchor hash, digest of the words, first window, number of windows) of each run."""
        n = len(words) - self.window + 1
        if n < 1:
            return np.zeros(0, np.int64), [], np.zeros(0, np.int32), np.zeros(0, np.int32)
        best = self.anchors(words)
        starts = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1])
        counts = np.diff(np.concatenate([starts, [n]]))
        return best[starts].view(np.int64), digests(words, starts, starts + counts + self.window - 1), starts.astype(np.int32), counts.astype(np.int32)


def digests(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit BLAKE2 digests of the words of each range: equal digests stand for equal words."""
    joined = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # splits bytes at exactly \x20 and \x09-\x0D


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(summary, spans).

    summary: id, key (hash of the text), n_words, digest, for every row.
    spans: id, key, spans (array<struct<a, b>>): word ranges covered by windows whose word sequence also
    starts in a document with a smaller id. Ranges of one document may overlap.

    1. Every window of words is an edge of the De Bruijn graph of the corpus, from its first words but the last
       to its last words but the first. Consecutive windows of a text that share their anchor (the least hash of
       a k-mer in the window) form a run, a path of edges; a stretch that repeats itself is one run, however
       long. Equal windows have equal anchors, so they are only ever found in runs with the same anchor. About
       one row per 20 words leaves this pass.
    2. A join on the anchor hash keeps runs whose anchor is met in two documents or more.
    3. Equal runs (digests of all their words) are compacted to one class with its smallest id. Where a class
       is always followed by the same other one and that one is never met elsewhere, the path does not branch:
       `compacted` joins such paths to their first class by pointer doubling, so a repeated passage is one path
       however long it is. In other documents than the one with the smallest id the whole path is covered, at
       the source coordinates of its first class.
    4. Where an anchor has several classes the runs differ in some words: only there, and only for one
       representative of a class, the run is expanded to its windows again, from its source coordinates, and
       windows are compared by digests of the words found there.

    No pairs of documents are formed; groups of copies meet in aggregates of their smallest id. Rows with a
    null id neither remove nor lose words. Repeated rows get the same result. Null texts have no words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(window)
        names = ["id", "key", "n_words", "digest", "anchor", "h", "start", "n"]
        for batch in batches:
            n, digest, parts = [], [], []
            for t in batch.column(2):
                words = _words(t.as_py())
                n.append(len(words))
                digest.append(_digest(words))
                parts.append(kernel.runs(words))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32))
            values = [pa.array(np.concatenate([p[0] for p in parts])), pa.array([h for p in parts for h in p[1]], pa.binary()), *(pa.array(np.concatenate([p[k] for p in parts])) for k in (2, 3))]
            lists = [pa.ListArray.from_arrays(ends, v) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest), *lists], names=names)

    schema = f"id {id_type}, key long, n_words long, digest string, anchor array<long>, h array<binary>, start array<int>, n array<int>"
    found = stored(rows.mapInArrow(cut, schema), "runs")
    summary = found.select("id", "key", "n_words", "digest")
    runs = found.where("id is not null").select("id", "key", F.inline(F.arrays_zip("anchor", "h", "start", "n")))
    several = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("anchor").alias("anchor_"))
    shared = stored(runs.join(several, F.col("anchor") == F.col("anchor_")).drop("anchor_").distinct(), "shared-runs")
    classes = shared.groupBy("h").agg(F.min(F.struct("id", "key", "start")).alias("first"), F.first("anchor").alias("anchor"), F.first("n").alias("n"), F.max("id").alias("last"), F.count("*").alias("met"))
    classes = stored(classes, "run-classes")
    branch = classes.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select(F.col("anchor").alias("anchor_"))
    open_ = classes.join(branch, F.col("anchor") == F.col("anchor_")).select("first.*", "n")
    per = open_.groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    here = rows.join(per.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "runs"), (F.col("id") == F.col("id_")) & (F.col("key") == F.col("key_"))).select("id", "key", "text", "runs")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, r) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                start, n = (np.asarray(r.values.field(k)) for k in range(2))
                which = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                w = digests(_words(t.as_py()), start[which] + offset, start[which] + offset + window)
                same = pa.array(np.full(len(which), i, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(start[which]), pa.array(offset.astype(np.int32)), pa.array(w, pa.binary())], names=["id", "key", "start", "offset", "w"])

    windows = stored(here.mapInArrow(expand, f"id {id_type}, key long, start int, offset int, w binary"), "windows")
    least = windows.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("w").alias("w_"), "lo")
    late = windows.join(least, F.col("w") == F.col("w_")).where("lo < id")
    part = late.groupBy("id", "key", "start").agg(F.collect_set("offset").alias("offsets")).withColumnsRenamed({"id": "p_id", "key": "p_key", "start": "p_start"})
    paths = compacted(shared, classes).withColumnRenamed("h", "path")
    judged = classes.join(part, (F.col("first.id") == F.col("p_id")) & (F.col("first.key") == F.col("p_key")) & (F.col("first.start") == F.col("p_start")), "left")
    judged = judged.join(paths, F.col("h") == F.col("path"), "left").where("total is not null or offsets is not null").select(F.col("h").alias("c"), F.col("first.id").alias("least"), "total", "offsets")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("total") + window - 1).cast("int").alias("b")))
    some = F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("a"), (F.col("start") + o + window).alias("b")))
    spans = (
        shared.join(judged, F.col("h") == F.col("c"))
        .select("id", "key", F.inline(F.when(F.col("least") < F.col("id"), F.when(F.col("total").isNotNull(), whole)).otherwise(some)))
        .groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    return summary, spans


def compacted(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, total): the first class of each repeated path and the number of windows of the whole path.

    Classes of two documents or more are joined where the path does not branch: the second follows the first
    wherever either is met, so both are met equally often, in the same documents. A document ends, so such paths
    have no cycles. Each round doubles how far a class sees back; the rounds are the logarithm of the longest
    path.
    """
    again = classes.where(F.col("first.id") < F.col("last")).select("h", "n", "met")
    order = W.partitionBy("id", "key").orderBy("start")
    follow = shared.select("h", F.lead("h").over(order).alias("to"), (F.lead("start").over(order) == F.col("start") + F.col("n")).alias("next"))
    steps = follow.where("next").groupBy("h", "to").agg(F.count("*").alias("times"))
    second = again.select(F.col("h").alias("h2"), F.col("met").alias("met2"))
    links = steps.join(again, "h").where("times = met").join(second, F.col("to") == F.col("h2")).where("times = met2 and h <> to")
    path = checkpoint(links.select(F.col("to").alias("node"), F.col("h").alias("up"), F.col("n").cast("long").alias("back")))
    while True:
        above = path.select(F.col("node").alias("node_"), F.col("up").alias("up_"), F.col("back").alias("back_"))
        joined = path.join(above, F.col("up") == F.col("node_"), "left")
        path = checkpoint(joined.select("node", F.coalesce("up_", "up").alias("up"), (F.col("back") + F.coalesce("back_", F.lit(0))).alias("back"), F.col("up_").isNotNull().alias("moved")))
        if not path.where("moved").limit(1).count():
            break
        path = path.drop("moved")
    member = again.join(path, F.col("h") == F.col("node"), "left")
    return member.groupBy(F.coalesce("up", "h").alias("h")).agg(F.max(F.coalesce("back", F.lit(0)) + F.col("n")).alias("total"))


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, kept, n_removed, digest) of the documents that have spans: their kept words joined by one space."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    here = rows.join(spans.withColumnsRenamed({"id": "id_", "key": "key_"}), (F.col("id") == F.col("id_")) & (F.col("key") == F.col("key_"))).select("id", "key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, digest = [], [], []
            for t, s in zip(batch.column(2), batch.column(3), strict=True):
                words = _words(t.as_py())
                a, b = (np.asarray(s.values.field(k)) for k in range(2))
                cover = np.cumsum(np.bincount(a, minlength=len(words) + 1) - np.bincount(b, minlength=len(words) + 1))[: len(words)] > 0
                left = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                kept.append(b" ".join(left).decode())
                removed.append(int(cover.sum()))
                digest.append(_digest(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["id", "key", "kept", "n_removed", "digest"])

    return here.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, kept string, n_removed long, digest string")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    summary, spans = repeated_spans(docs)
    cut = cut_spans(docs, spans).select(F.col("id").alias("id_"), F.col("key").alias("key_"), "n_removed", F.col("digest").alias("digest_")).dropDuplicates(["id_", "key_"])
    rows = summary.join(cut, (F.col("id") == F.col("id_")) & (F.col("key") == F.col("key_")), "left")
    return rows.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("digest_", "digest").alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM i),
m AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (h) WHERE lo < doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS t FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
