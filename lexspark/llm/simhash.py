"""SimHash near-dedup by vantage-point trees over Hamming distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, components, fresh, stored, table

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Most fingerprints in one block of a shard, on average.
BLOCK = 1024
#: Fingerprints the driver looks at to choose vantage points: a fixed bound.
SAMPLE = 4096


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of every shingle, repeats included: lower-case A-Z, words; a text of fewer words is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    d = xxhash.xxh64_intdigest
    return np.array([d(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: lower-case A-Z, words, shingles with repeats, XXH64; majority per bit."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    if not len(h):
        return 0
    set_ = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        set_ += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs without its text column, plus the fingerprint as a signed long."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(k)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != k], pa.array(fps)], names=schema.names)

    return docs.mapInArrow(run, schema)


# ---- the trees --------------------------------------------------------------------------------------

#: Levels of a tree on half of the fingerprint: each looks at two bits, so a distance is 0, 1 or 2.
LEVELS = 16
_FIELDS = 0x55555555


def ball(levels: int, radius: int) -> list[int]:
    """All offsets of packed distance vectors (two bits a level) whose absolute values sum to `radius` at most."""
    found = {0: 0}
    for i in range(levels):
        found = {o + (d << 2 * i): n + abs(d) for o, n in found.items() for d in range(-radius, radius + 1) if n + abs(d) <= radius}
    return sorted(found)


def vantage_points(sample: np.ndarray, levels: int = LEVELS) -> list[int]:
    """The vantage point of each part, of every two bits the value whose distances spread most over a sample."""
    out = []
    for part in range(0, 64, 2 * levels):
        v = 0
        for i in range(part, part + 2 * levels, 2):
            bits = (sample >> np.uint64(i)) & np.uint64(3)
            spread = [sum(float(np.mean(np.bitwise_count(bits ^ np.uint64(x)) == d)) ** 2 for d in range(3)) for x in range(4)]
            v |= int(np.argmin(spread)) << (i - part)
        out.append(v)
    return out


def shard_of(fp: Column, part: int, point: int, levels: int = LEVELS) -> Column:
    """The packed distances of one part of a fingerprint to its vantage point, level by level."""
    x = F.shiftrightunsigned(fp, 2 * levels * part).bitwiseAND(F.lit((1 << 2 * levels) - 1)).bitwiseXOR(F.lit(point))
    return x.bitwiseAND(F.lit(_FIELDS)) + F.shiftright(x, 1).bitwiseAND(F.lit(_FIELDS))


def shard_pairs(blocks: DataFrame, radius: int, levels: int = LEVELS) -> DataFrame:
    """Pairs of blocks whose shards overlap at a boundary: each shard meets itself and the shards ahead of it."""
    ahead = F.array(*[F.lit(o).cast("long") for o in ball(levels, radius // (32 // levels)) if o > 0])
    inside = lambda c: (c >= 0) & (c.bitwiseAND(F.shiftright(c, 1)).bitwiseAND(F.lit(_FIELDS)) == 0)  # noqa: E731  no distance is 3
    reach = F.filter(F.transform(ahead, lambda o: F.col("shard") + o), inside)
    to = blocks.select("tree", F.explode(F.concat(F.array("shard"), reach)).alias("to"), F.col("shard").alias("from"), F.col("block").alias("from_block"), F.col("fps").alias("left"))
    to = to.where((F.col("from") != F.col("to")) | (F.size("left") > 1) | (F.col("from_block") >= 0))
    right = blocks.select(F.col("tree").alias("tree_"), F.col("shard").alias("shard_"), F.col("block").alias("to_block"), F.col("fps").alias("right"))
    met = to.join(right, (F.col("tree") == F.col("tree_")) & (F.col("to") == F.col("shard_")))
    return met.where((F.col("from") != F.col("to")) | (F.col("from_block") <= F.col("to_block"))).select("left", "right")


def link_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many links, a spanning forest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= len(nodes):
        return a, b
    top = list(range(len(nodes)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            keep.append(i)
    return a[keep], b[keep]


def compare(left: pa.ListArray, right: pa.ListArray, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the fingerprints of each two lists, as forests; about `most` pairs are looked at a time."""
    l, r = (np.asarray(x.flatten()).view(np.uint64) for x in (left, right))
    nl, nr = (np.asarray(x.value_lengths()).astype(np.int64) for x in (left, right))
    al, ar = np.cumsum(nl) - nl, np.cumsum(nr) - nr
    ends = np.cumsum(nl * nr)
    i = 0
    while i < len(nl):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        # one row for each element of a left list, then its right list
        rows = np.repeat(np.arange(i, j), nl[i:j])
        x = l[np.arange(len(rows)) - np.repeat(np.cumsum(nl[i:j]) - nl[i:j], nl[i:j]) + al[rows]]
        each = nr[rows]
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(ar[rows], each)
        a, b = np.repeat(x, each), r[at]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        if near.any():
            yield link_forest(a[near], b[near])
        i = j


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) whose components are those of all pairs at up
    to `radius` differing bits.

    Two vantage-point trees, one for each half of the bits (four up to a radius of 7, eight up to 15, ...): of
    two fingerprints within `radius`, one of the parts is within radius // parts, which is 1 or 0. Every level
    of a tree partitions by the Hamming distance to the vantage point on two bits of its part. The bits of the
    levels are disjoint, so by the triangle inequality the changes of the distances add up to the distance of
    the parts at most: branches beyond a total of radius // parts are pruned, and a shard is queried from itself
    and the shards at its boundary. What is pruned cannot hold a pair, so the links are exact. A tree of half
    the bits has 3^16 leaves at any size, one of a quarter 3^8, so wider radii compare more; leaves with more
    than BLOCK fingerprints are cut by a hash, and their blocks meet one another.
    """
    spark = distinct.sparkSession
    parts = 2
    while radius // parts > 1:
        parts *= 2
    levels = 32 // parts
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    trees = F.array(*[F.struct(F.lit(k).alias("tree"), shard_of(F.col("fp"), k, v, levels).alias("shard")) for k, v in enumerate(vantage_points(sample, levels))])
    placed = distinct.select("fp", F.inline(trees))
    big = checkpoint(placed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1")).withColumnsRenamed({"tree": "tree_", "shard": "shard_"})
    # a shard with more than a block is cut by a hash before its fingerprints are gathered; an uncut one has block -1
    cut = placed.join(big, (F.col("tree") == F.col("tree_")) & (F.col("shard") == F.col("shard_")), "left")
    cut = cut.select("tree", "shard", "fp", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("n")), F.lit(-1)).cast("int").alias("block"))
    blocks = stored(cut.groupBy("tree", "shard", "block").agg(F.collect_list("fp").alias("fps")), "vp-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in compare(batch.column(0), batch.column(1), radius):
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (a, b)], names=["a", "b"])

    return shard_pairs(blocks, radius, levels).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the carried columns, fp, root (a fingerprint that names the component) and
    component_id, the smallest id reachable over links of up to `radius` bits, itself included.

    Texts are read once. Equal fingerprints are one class, so groups of copies are never expanded; null and
    empty texts have fingerprint 0 and link like any other. A null id takes part, but names a component only
    if all its ids are null.
    """
    rows = stored(fingerprints(docs.select(id_col, *carry, text), text), "fingerprints")
    classes = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    comp = components(fingerprint_links(classes.select("fp"), radius))
    named = classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    byfp = named.select("fp", "root").join(low, "root").withColumnRenamed("fp", "fp_")
    return rows.join(byfp, F.col("fp") == F.col("fp_")).drop("fp_")


def keep_first(docs: DataFrame, id_col: str, grouped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs with one row of each group: the one with the smallest (id, row hash); columns unchanged.
    grouped: from docs with a row hash, and the name of that column, to rows (id, row hash, root)."""
    key, kept = fresh(docs, "__lx_row"), fresh(docs, "__lx_kept")
    hashed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t]))
    groups = grouped(hashed, key)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row"))).alias("first"))
    ids = checkpoint(first.select(F.col("first.id").alias(kept), F.col("first.row").alias(f"{kept}2")))
    # by the row hash alone, so that the repeated rows that are left need no further shuffle
    a, b = F.col(id_col), F.col(kept)
    same = ((a <= b) & (a >= b)) | (a.isNull() & b.isNull())
    one = hashed.join(ids, (F.col(key) == F.col(f"{kept}2")) & same, "left_semi")
    return one.dropDuplicates([id_col, key]).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """docs with one row of each component: the one with the smallest (id, row hash); columns unchanged."""
    return keep_first(docs, id_col, lambda hashed, key: near_duplicates(hashed, id_col, text, radius, carry=(key,)))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
