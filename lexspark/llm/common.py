"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many rows may be broadcast; the row count is measured first.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexspark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide table as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not use, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def attach(df: DataFrame, small: DataFrame, on: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join df with a small table (already materialised) on one column, nulls equal, without a hot task.

    The small side is counted: up to BROADCAST_ROWS it is broadcast, beyond that both sides carry a
    salt, so a key with a third of all rows spreads over `salts` tasks.
    """
    right = small.withColumnRenamed(on, "__lx_on")
    same = F.col(on).eqNullSafe(F.col("__lx_on"))
    if small.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), same, how).drop("__lx_on")
    left = df.withColumn("__lx_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = right.withColumn("__lx_salt_", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, same & (F.col("__lx_salt") == F.col("__lx_salt_")), how).drop("__lx_on", "__lx_salt", "__lx_salt_")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component = smallest node.

    Alternating large-star and small-star joins; every round's edges are checkpointed, and the loop ends
    when a round leaves the count and the hash sum of the edges unchanged. Only those two numbers reach
    the driver. Nodes without an edge to another node do not appear.
    """
    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = checkpoint(e)
    before = signature(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(
            F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        )
        e = checkpoint(small.where("u != v").distinct())
        now = signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of a string column."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
