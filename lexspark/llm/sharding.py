"""Sharding by a hypergeometric communication matrix."""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import fresh, stored, table

#: Logical partitions and second-permutation buckets: bounds of what reaches the driver.
MAX_PARTS = 4096
ROWS_PER_PART = 25_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact hypergeometric draw; beyond numpy's limit of 1e9, inversion outward from the mode."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    p = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right, u = right + 1, u - pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left, u = left - 1, u - pl
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Random matrix with the given row and column sums: how many rows each partition sends to each shard
    when all rows are shuffled uniformly."""
    rng, left, out = np.random.default_rng(seed), list(columns), np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            out[i, j] = k = hypergeometric(rng, left[j], rest, n) if n else 0
            left[j] -= k
            n -= k
    return out


def shuffle_shards(df: DataFrame, shards: int = 8, seed: int = 42, keys: list[str] | None = None, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Deal all rows of df uniformly at random into `shards` shards whose sizes differ by one at most.

    1. Rows fall into logical partitions by a hash of `keys` (default: all columns), and are counted.
    2. The driver draws the partition-to-shard matrix, whose row sums are those counts and whose column
       sums are the exact shard sizes (at most MAX_PARTS rows of numbers).
    3. Each partition is permuted by a seeded hash, and its first rows go to shard 0, the next to 1, ...
    4. Each shard is permuted again by a second hash. Its order is cut into hash ranges, so a slot is the
       offset of the range plus the rank in it, and no task holds a shard.

    The same rows and seed give the same shards, however Spark partitions them and whatever is recomputed.
    Rows that are equal in all `keys` are interchangeable. Null keys are hashed like any value; an empty
    table gives an empty result. Adds int `shard` and gapless long `slot`.
    """
    spark = df.sparkSession
    keys = keys or [c for c, t in df.dtypes if "map" not in t]
    part, o1, o2, at, rng_ = (fresh(df, f"__lx_{x}") for x in ("part", "o1", "o2", "at", "range"))
    n = df.count()
    parts = int(min(MAX_PARTS, max(64, -(-n // ROWS_PER_PART))))
    h = lambda k: F.xxhash64(F.lit(seed + k), *[F.col(f"`{c}`") for c in keys])
    rows = df.withColumns({part: F.pmod(h(0), F.lit(parts)).cast("int"), o1: h(1), o2: h(2)})
    counts = dict(rows.groupBy(part).count().collect())
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed)
    ends = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(matrix[p])]) for p in range(parts)],
        T.StructType([T.StructField("__lx_p", T.IntegerType()), T.StructField("__lx_ends", T.ArrayType(T.LongType()))]),
    )
    ties = [F.col(f"`{c}`") for c in keys]
    dealt = (
        rows.withColumn(at, F.row_number().over(W.partitionBy(part).orderBy(o1, *ties)))
        .join(F.broadcast(ends), F.col(part) == F.col("__lx_p"))
        .withColumn(shard, F.size(F.filter("__lx_ends", lambda e: e < F.col(at))).cast("int"))
        .withColumn(rng_, F.shiftrightunsigned(F.col(o2), 64 - int(np.ceil(np.log2(max(2, parts // shards))))).cast("int"))
        .drop("__lx_p", "__lx_ends", part, o1, at)
    )
    dealt = stored(dealt, "shards")
    seen = sorted(tuple(r) for r in dealt.groupBy(shard, rng_).count().collect())
    offsets, total, last = [], 0, None
    for s, r, c in seen:
        total = total if s == last else 0
        offsets.append((s, r, total))
        total, last = total + c, s
    where = spark.createDataFrame(offsets, "__lx_s int, __lx_r int, __lx_offset long")
    # hash ranges are ordered as signed numbers inside a range of the top bits, so ranks follow the ranges
    ranked = dealt.withColumn(at, F.row_number().over(W.partitionBy(shard, rng_).orderBy(o2, *ties)))
    return (
        ranked.join(F.broadcast(where), (F.col(shard) == F.col("__lx_s")) & (F.col(rng_) == F.col("__lx_r")))
        .withColumn(slot, F.col("__lx_offset") + F.col(at) - 1)
        .drop("__lx_s", "__lx_r", "__lx_offset", o2, rng_, at)
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`. Null texts have size 1 and checksum 0."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shuffle_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
