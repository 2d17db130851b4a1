"""Near-dedup by the exact Jaccard similarity of word shingles: candidates by SimHash, by prefix filtering what it misses."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, stored
from .simhash import fingerprint_links, keep_first, majority, shingle_hashes

#: Words of a shingle; least similarity of a link, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Most differing bits of the fingerprints of candidates.
RADIUS = 7
#: Documents whose shingles are counted to put frequent ones last, and frequent shingles kept: fixed bounds.
SAMPLE, FREQUENT = 8192, 200_000
#: Parts of the hashes that a sketch counts: a power of two.
BUCKETS = 256
#: Rows a Python worker holds the sets of at a time, and log2 of the bits of the map of wanted rows: fixed bounds.
SLICE, MAP_BITS = 256, 24


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # glibc only


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each, memory that the worker no longer uses, of earlier operators too, goes back to the system."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        _trim(0)
        yield batch


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a text of fewer words is one shingle, no words none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all sets: one more than a partner may lack.

    Any total order is right: two sets that reach the similarity share a shingle of both prefixes. Frequent
    shingles come last only to keep the groups small.
    """
    if not len(s):
        return s
    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    late = np.where(frequent[at] == s, rank[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
    num, den = LEAST
    return s[np.lexsort((s, late))[: len(s) - -(-num * len(s) // den) + 1]]


def possible(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that share the i-th of one and the j-th of the other, and none before, can link."""
    num, den = LEAST
    return (num + den) * np.minimum(n - i, m - j) >= num * (n + m)


def _frequent(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks) of the shingles that are frequent in a hash sample of documents."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) * F.lit(max(1, n)) < F.lit(SAMPLE << 30)) if n > SAMPLE else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lean(batches):
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py()).view(np.int64))], names=["s"])

    top = some.select(text).mapInArrow(run, "s long").groupBy("s").count().where("count >= 3").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    s = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.array([r[1] for r in top], np.int64)[order]


def _candidates(groups: DataFrame, leaders: bool) -> DataFrame:
    """(a, b): pairs of a group's members that can link; with `leaders`, of its first member and the others only,
    else of members of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lean(batches):
            out: set[tuple[bytes, bytes]] = set()
            for g in batch.column(0):
                names, n, at, comp = (g.values.field(k) for k in range(4))
                names, n, at = names.to_pylist(), np.asarray(n).astype(np.int64), np.asarray(at).astype(np.int64)
                first = names.index(min(names)) if leaders else 0
                comp = None if leaders else np.unique(np.array([x.hex() for x in comp.to_pylist()]), return_inverse=True)[1]
                for i in [first] if leaders else range(len(names)):
                    ok = possible(n[i], n, at[i], at)
                    ok &= np.arange(len(names)) != i if leaders else (np.arange(len(names)) > i) & (comp != comp[i])
                    out.update((min(names[i], names[j]), max(names[i], names[j])) for j in np.flatnonzero(ok).tolist())
                    if len(out) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
                        out = set()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return groups.select("members").mapInArrow(run, "a binary, b binary")


def simhash_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of classes (cls, fp) that connect all classes whose fingerprints are linked over up to `radius`
    differing bits, through the vantage-point trees; classes with one fingerprint meet the first of them."""
    lead = checkpoint(classes.groupBy("fp").agg(F.min("cls").alias("lead")))
    same = classes.join(lead.withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).where("cls != lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    left, right = (lead.select(F.col("fp").alias(f"{c}_"), F.col("lead").alias(f"l{c}")) for c in "ab")
    near = fingerprint_links(lead.select("fp"), radius).distinct()
    near = near.join(left, F.col("a") == F.col("a_")).join(right, F.col("b") == F.col("b_"))
    return near.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).unionByName(same)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of BUCKETS parts of the hashes; empty where a count passes a byte."""
    n = np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def _may_reach(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether two sets can reach the similarity: in each bucket they share the smaller of both counts at most."""
    out = np.ones(len(a), bool)
    at = np.array([i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y], np.int64)
    if len(at):
        x, y = (np.frombuffer(b"".join(v[i] for i in at.tolist()), np.uint8).reshape(len(at), BUCKETS) for v in (a, b))
        num, den = LEAST
        out[at] = (num + den) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= num * (x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64))
    return out


def _wanted(keys: DataFrame) -> np.ndarray:
    """A map of 2^MAP_BITS bits with those of the keys set: as large for any number of keys."""
    low = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = keys.select(F.shiftright(low, 6).alias("w"), low.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return out


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the pairs whose whole texts reach the similarity, the sets of all classes met). Pairs first meet by the
    sketches. The texts of those not ruled out whose sets are not known are read again for their sets, in a narrow
    pass: a map of bits tells which rows are wanted, and what it lets through beside them meets no pair. What is
    left of many partitions is rebalanced before it is written, so that it makes few files."""
    num, den = LEAST

    def joined(rows: DataFrame, s: DataFrame, column: str) -> DataFrame:
        left, right = (s.select(F.col("cls").alias(f"{c}_"), F.col(column).alias(f"s{c}")) for c in "ab")
        return rows.join(left, F.col("a") == F.col("a_")).join(right, F.col("b") == F.col("b_")).select("a", "b", "sa", "sb")

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lean(batches):
            keep = pa.array(_may_reach(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lean(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                keep.append((num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    pairs = checkpoint(joined(pairs.distinct(), classes, "sketch").mapInArrow(rough, "a binary, b binary").hint("rebalance"))
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    if known is not None:
        need = need.join(known.select("cls"), "cls", "left_anti")
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(classes.join(need, "cls").select("key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lean(batches):
            low = np.asarray(batch.column(0)) & ((1 << MAP_BITS) - 1)
            texts = batch.column(1).filter(pa.array((wanted.value[low >> 6] >> (low & 63) & 1).astype(bool)))
            for i in range(0, len(texts), SLICE):
                s = [shingle_set(x.as_py()) for x in texts.slice(i, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in s], pa.binary()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64()))], names=["cls", "s"])

    s = stored(docs.select(key, text).mapInArrow(sets, "cls binary, s array<long>"), "similar-sets")
    s = s if known is None else s.unionByName(known)
    return checkpoint(joined(pairs, s.dropDuplicates(["cls"]), "s").mapInArrow(check, "a binary, b binary").hint("rebalance")), s


def _digest(s: np.ndarray) -> bytes:
    """The name of the class of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def groups(docs: DataFrame, id_col: str, key: str, text: str = "text") -> DataFrame:
    """(id, key, root) of every row: root names the component over links of Jaccard similarity LEAST and more.

    key is a hash of the whole row. Equal shingle sets are one class, so groups of copies are never expanded.
    Candidates are the classes whose SimHash fingerprints (over the set of shingles) meet within RADIUS bits through
    the vantage-point trees. Fingerprints alone would lose pairs, so there is an exact way for the rest: classes that
    share a shingle of their prefixes form groups. Every group's members meet its first member. All candidates
    are confirmed on the whole texts. Then, in groups of three and more, members of different components
    meet each other: what is left out is connected already. So all components are those of all pairs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(docs, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _lean(batches):
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                s = [shingle_set(x.as_py()) for x in batch.column(2)]
                first = pa.array([prefix(x, *shared.value).view(np.int64) for x in s], pa.list_(pa.int64()))
                cls, sketches = (pa.array([f(x) for x in s], pa.binary()) for f in (_digest, sketch))
                fp = pa.array(np.array([majority(x) for x in s], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cls, pa.array([len(x) for x in s], pa.int32()), first, fp, sketches], names=[id_col, key, "cls", "n", "first", "fp", "sketch"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{key}` long, cls binary, n int, first array<long>, fp long, sketch binary"
    rows = stored(docs.select(id_col, key, text).mapInArrow(run, schema), "similar-rows")
    classes = stored(rows.groupBy("cls").agg(F.min(key).alias("key"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "similar-classes")
    one = rows.join(classes.select(F.col("cls").alias("cls_"), F.col("key").alias("key_")), (F.col("cls") == F.col("cls_")) & (F.col(key) == F.col("key_"))).dropDuplicates(["cls", key])
    each = one.select("cls", "n", F.posexplode("first").alias("at", "s"))
    member = F.struct("cls", "n", "at", F.lit(None).cast("binary").alias("comp"))
    met = stored(each.groupBy("s").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1).hint("rebalance"), "similar-groups")
    near = simhash_pairs(classes.select("cls", "fp"))
    links, sets = _confirmed(_candidates(met, True).unionByName(near), classes, docs, key, text)
    comp = checkpoint(components(links))
    wide = met.where(F.size("members") > 2).select("s", F.inline("members")).drop("comp").join(comp, F.col("cls") == F.col("node"), "left")
    member = F.struct("cls", "n", "at", F.coalesce("component", "cls").alias("comp"))
    apart = wide.groupBy("s").agg(F.collect_list(member).alias("members"), F.countDistinct(F.coalesce("component", "cls")).alias("parts")).where("parts > 1")
    more, _ = _confirmed(_candidates(apart, False), classes, docs, key, text, sets)
    comp = checkpoint(components(links.unionByName(more)))
    roots = rows.select(id_col, key, "cls").join(comp, F.col("cls") == F.col("node"), "left")
    return roots.select(id_col, key, F.coalesce("component", "cls").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest (id, row hash); columns unchanged."""
    return keep_first(docs, id_col, lambda hashed, key: groups(hashed, id_col, key, text))
