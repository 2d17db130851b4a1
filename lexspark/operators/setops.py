"""Token-set algebra over tables with a `token` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("token").union(b.select("token")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of one side only, tagged `a` or `b`: one aggregate instead of two anti joins."""
    both = a.select("token", F.lit(1).alias("side")).union(b.select("token", F.lit(2).alias("side")))
    return both.groupBy("token").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").select("token", F.when(F.col("lo") == 1, "a").otherwise("b").alias("only_in"))


def without_special(tokens: DataFrame, special: DataFrame) -> DataFrame:
    """Tokens that contain no special token. Special tokens are few by construction, so each task scans them."""
    s = special.select(F.hex("token").alias("s"))
    t = tokens.withColumn("__hex", F.hex("token"))
    # at an even position, so that bytes are not matched across their hex digits
    return t.join(F.broadcast(s), F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__hex")), F.lit(2)), lambda i: F.substring(F.col("__hex"), i, F.length("s")) == F.col("s")), "left_anti").drop("__hex")


def drop_marked_twins(tokens: DataFrame) -> DataFrame:
    """Tokens that start with a delete mark and a space, without them; then distinct."""
    t = F.col("token")
    plain = F.when(F.hex(F.substring(t, 1, 2)) == "4420", F.substring(t, F.lit(3), F.length(t))).otherwise(t)
    return tokens.select(plain.alias("token")).where(F.length("token") > 0).distinct()


def add_missing(base: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """base and the first `limit` tokens of `more`, in dictionary order, that it lacks."""
    fresh = more.select("token").distinct().join(base.select("token"), "token", "left_anti").orderBy(F.length("token"), "token").limit(limit)
    return base.select("token").union(fresh)


def fingerprint(tokens: DataFrame) -> DataFrame:
    """An order-free fingerprint of a token set: sums of hashes, combined before the shuffle."""
    h = F.xxhash64("token").cast("decimal(20,0)")
    return tokens.select("token").distinct().agg(F.count("*").alias("n"), F.sum(h).alias("h1"), F.sum(F.xxhash64("token", F.lit(1)).cast("decimal(20,0)")).alias("h2"))
