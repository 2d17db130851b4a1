"""Corpus preparation: reading, capping, cropping, one row for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.charclass import strip_non_latin_col

TEXT_COLUMNS = ("content", "text", "body")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole plain-text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The key `text` of JSON lines; rows without it are left out."""
    return spark.read.schema("text string").json(path).select(F.input_file_name().alias("path"), "text").where("text is not null")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Texts of the columns content, text and body, in this order, nulls dropped; only those columns are read."""
    df = spark.read.parquet(path)
    have = [c for c in TEXT_COLUMNS if c in df.columns]
    if not have:
        raise ValueError(f"none of the columns {TEXT_COLUMNS} in {path}")
    return df.select(F.input_file_name().alias("path"), F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.col(c).cast("string").alias("text")) for i, c in enumerate(have)]))).where("text is not null")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a folder or glob of .jsonl, .parquet and .txt files."""
    base = path.rstrip("/")
    parts = []
    for suffix, read in ((".jsonl", read_jsonl), (".parquet", read_parquet), (".txt", read_text)):
        try:
            parts.append(read(spark, f"{base}/*{suffix}").select("path", "text"))
        except Exception as e:  # no file with that suffix
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_special(spark: SparkSession, path: str) -> list[str]:
    """{"special": [...]}: an error if there is none, or one of a single byte."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "special array<string>")["special"]).alias("s")).collect()
    found = [r[0] for r in rows]
    if not found or any(len(s.encode()) < 2 for s in found):
        raise ValueError("special tokens are missing, or one is a single byte")
    return found


def size_cap(df: DataFrame, most: int, order: str, text: str = "text", unit: str = "bytes", overshoot: bool = False) -> DataFrame:
    """Rows in order while their running size, one separator each, stays within `most`.

    overshoot: a row is taken if the size before it is within the cap. The running sum is made of sums of
    order ranges: only the per-range totals meet in one task, so no task holds the table.
    """
    n = (F.octet_length(text) if unit == "bytes" else F.length(text)) + 1
    rows = df.withColumn("__n", n.cast("long"))
    bounds = rows.approxQuantile(order, [i / 64 for i in range(1, 64)], 0.005) if dict(rows.dtypes)[order] in ("bigint", "int", "double") else []
    rows = rows.withColumn("__range", F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b <= F.col(order))) if bounds else F.lit(0))
    per = rows.groupBy("__range").agg(F.sum("__n").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    run = F.sum("__n").over(W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(per), "__range").withColumn("__run", F.col("__before") + run)  # at most 64 rows
    keep = F.col("__run") - F.col("__n") <= most if overshoot else F.col("__run") <= most
    return rows.where(keep).drop("__n", "__range", "__before", "__run")


def middle_lines(text: Column, most: int = 200) -> Column:
    """Texts of more than `most` lines are cropped to that many around the middle."""
    lines = F.split(text, "\n")
    mid = F.floor(F.size(lines) / 2).cast("int")
    return F.when(F.size(lines) > most, F.array_join(F.slice(lines, mid - most // 2 + 1, F.lit(most)), "\n")).otherwise(text)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: an aggregate with partial combining, so hot keys cost nothing."""
    row = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in df.columns])
    first = df.groupBy(F.col(key).alias("__k")).agg(F.min_by(row, F.col(order)).alias("__r"))
    return first.select(*[F.col("__r")[c].alias(c) for c in df.columns])


def latin_only(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, strip_non_latin_col(F.col(text)))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, the common entities decoded, spaces collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))
