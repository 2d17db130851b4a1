"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, attach, checkpoint, fresh, table, unit


#: Hash draws fall into so many bins, at whose edges the words taken are known.
BINS = 4096


def words_in(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target): one row per source, sources by code point with null last.

    Weights repeat `cycle` in that order and share the total of all sizes; a target stops at `most` times
    its source's size, and the excess goes to the others by weight until none is above. With the sources
    ordered by cap/weight the stopped ones are a prefix, so the level of the others is one pass of running
    sums over the table of sources (numbers only).
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("s"))
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((rank - 1) % len(cycle) + 1).cast("int")))
    per = per.withColumn("r", F.lit(most) * F.col("s") / F.col("w"))
    before = W.orderBy("r", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    per = per.withColumns({
        "left": F.sum("s").over(every) - F.lit(most) * F.coalesce(F.sum("s").over(before), F.lit(0)),
        "weights": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    level = F.col("left") / F.col("weights")
    at = F.min(F.when(level <= F.col("r"), F.struct("r", level.alias("level")))).over(every)["level"]
    return per.withColumn("target", F.when(F.coalesce(at, F.lit(0.0)) * F.col("w") >= F.lit(most) * F.col("s"), F.lit(most) * F.col("s")).otherwise(at * F.col("w"))).select(
        "source", F.col("s").alias("source_size"), "target"
    )


def _draw(id_col: Column, seed: int) -> Column:
    """The bin of a row's hash draw, 0 to BINS - 1."""
    return F.floor(unit(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))) * BINS).cast("int")


def _class(size: Column) -> Column:
    """Binary digits of a size: documents of one class differ in size by a factor of two at most."""
    return F.length(F.bin(size))


def plan(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate, cuts): from rows (source, size, bin), how the mix takes each source.

    A row is taken floor(rate) times, and once more if its bin is below the cut of its size class. The draws are
    hashes, so a cut at fraction * BINS would be a Bernoulli copy with that probability; cuts are moved to the
    edges of the bins at which the words taken come nearest to the target, from the largest class to the
    smallest, each making up for what the larger ones missed. Counts are combined by (source, class, bin)
    before the shuffle: of a source, at most BINS numbers for each of its classes are held together.
    """
    per = targets(sizes, "source", "size", most=most)
    per = checkpoint(per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    bins = sizes.groupBy("source", _class(F.col("size")).alias("cls"), "bin").agg(F.sum("size").alias("s"))
    edges = bins.withColumn("cum", F.sum("s").over(W.partitionBy("source", "cls").orderBy("bin")))
    classes = edges.groupBy("source", "cls").agg(F.collect_list(F.struct((F.col("bin") + 1).alias("b"), "cum")).alias("edges"), F.sum("s").alias("total"))
    whole = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("cls", "total", "edges")), asc=False).alias("classes"))
    both = per.join(whole.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
    fraction = F.col("rate") - F.floor("rate")
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("words"), F.array().cast("array<struct<cls:int,cut:int>>").alias("cuts"))

    def step(acc: Column, c: Column) -> Column:
        words = acc["words"] + c["total"]
        options = F.concat(F.array(F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("cum"))), c["edges"])
        best = F.array_min(F.transform(options, lambda e: F.struct(F.abs((acc["taken"] + e["cum"]).cast("double") - fraction * words).alias("miss"), e["b"].alias("b"), e["cum"].alias("cum"))))
        return F.struct((acc["taken"] + best["cum"]).alias("taken"), words.alias("words"), F.concat(acc["cuts"], F.array(F.struct(c["cls"].alias("cls"), best["b"].alias("cut")))).alias("cuts"))

    cuts = F.aggregate("classes", start, step, lambda acc: F.map_from_entries(acc["cuts"]))
    return checkpoint(both.select("source", "source_size", "target", "rate", cuts.alias("cuts")))


def _copies(rate: Column, cuts: Column, size: Column, bin_: Column) -> Column:
    return (F.floor(rate) + (bin_ < F.coalesce(F.element_at(cuts, _class(size)), F.lit(0))).cast("int")).cast("int")


def mix_rates(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text: str = "text", source: str = "source", most: float = 3.0) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row: how often the mix takes it.

    copies = floor(rate) plus one hash-seeded copy with a probability of about rate - floor(rate), where rate =
    target / source_size of its source; `plan` says how the draw keeps each source near its target. The draw is
    a hash of (seed, id): rows that repeat an id share it, reruns agree. Null texts have size 0; a null source
    is a source of its own; a source of size 0 has rate 0; an empty table gives none. Texts are read once, for
    their sizes; other columns of docs are not looked at.
    """
    sizes = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), _draw(F.col(id_col), seed).alias("bin")))
    rows = attach(sizes, plan(sizes, most), "source")
    return rows.select("id", "source", "size", "source_size", "target", _copies(F.col("rate"), F.col("cuts"), F.col("size"), F.col("bin")).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: every row of docs as often as mix_rates says, columns unchanged.

    Two passes over docs, no shuffle of texts: the plan of the sources is joined to the rows. Null and empty
    texts are taken like others, at the rate of their source but without the further copy if it has no words at
    all. Rows that repeat an id are taken equally often. Temporary columns avoid the names in docs.
    """
    size, bin_ = words_in(F.col(text)), _draw(F.col(id_col), seed)
    per = plan(docs.select(F.col(source).alias("source"), size.alias("size"), bin_.alias("bin")))
    rate, cuts, key, copy = (fresh(docs, f"__lx_{c}") for c in ("rate", "cuts", "source", "copy"))
    rows = attach(docs.withColumn(key, F.col(source)), per.select(F.col("source").alias(key), F.col("rate").alias(rate), F.col("cuts").alias(cuts)), key)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(F.col(rate), F.col(cuts), size, bin_)))).select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix_rates(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS s, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * s / w AS r FROM p),
l AS (SELECT *, sum(s) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(s) OVER b, 0)::DOUBLE AS lft, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS ws
      FROM r WINDOW b AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce(arg_min(lft / ws, r) FILTER (WHERE lft / ws <= r), 0.0) AS level FROM l),
t AS (SELECT source, s, CASE WHEN level * w >= 3.0 * s THEN 3.0::DOUBLE * s ELSE level * w END AS target FROM l, v),
x AS (SELECT d.doc_id, d.size, t.s AS source_size, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0.0 END AS rate, coalesce('=' || d.source, '') AS k, length(bin(d.size)) AS cls,
      floor(('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 4096)::INTEGER AS bin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT k, cls, bin, sum(size)::BIGINT AS s FROM x GROUP BY ALL),
c AS (SELECT k, cls, row_number() OVER (PARTITION BY k ORDER BY cls DESC) AS c, total, sum(total) OVER (PARTITION BY k ORDER BY cls DESC) AS words FROM (SELECT k, cls, sum(s) AS total FROM h GROUP BY ALL)),
g AS (SELECT c.k, c.cls, c.c, (q.rate - floor(q.rate)) * c.words::DOUBLE AS goal FROM c JOIN (SELECT DISTINCT k, rate FROM x) q ON q.k = c.k),
e AS (SELECT k, cls, bin + 1 AS b, (sum(s) OVER (PARTITION BY k, cls ORDER BY bin))::BIGINT AS cum FROM h UNION ALL SELECT k, cls, 0, 0 FROM c),
o AS (SELECT g.k, g.c, g.cls, g.goal, e.b, e.cum FROM g JOIN e ON e.k = g.k AND e.cls = g.cls),
z AS (SELECT DISTINCT k, 0::BIGINT AS c, 0 AS cls, 0::BIGINT AS taken, 0 AS cut FROM c UNION ALL
      SELECT k, c + 1, m.cls, taken + m.cum, m.b FROM (SELECT z.k, z.c, z.taken, min({'miss': abs((z.taken + o.cum)::DOUBLE - o.goal), 'b': o.b, 'cum': o.cum, 'cls': o.cls}) AS m FROM z JOIN o ON o.k = z.k AND o.c = z.c + 1 GROUP BY z.k, z.c, z.taken)),
y AS (SELECT x.*, (floor(rate) + CASE WHEN bin < z.cut THEN 1 ELSE 0 END)::INTEGER AS copies FROM x JOIN z ON z.k = x.k AND z.cls = x.cls AND z.c > 0)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM y
"""
