"""Embedding near-dedup with randomised-rotation binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, checkpoint, components, stored, table

#: Vectors of one block: two blocks are compared in one task row.
BLOCK = 512
#: Vectors the driver looks at to choose the cells of the index: a fixed bound.
SAMPLE, CELLS = 2048, 64
#: Deviations of the confidence bound; 0: the certain bound alone.
EPSILON = 7.0


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix; its columns turn vectors before their signs are taken."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as +-1/sqrt(D), correction factors): the factor is the inner product of a vector and its code."""
    turned = unit @ turn
    codes = np.where(turned >= 0, 1.0, -1.0).astype(np.float32) / np.sqrt(np.float32(unit.shape[1]))
    return codes, np.einsum("ij,ij->i", codes, turned)


def pack(codes: np.ndarray) -> np.ndarray:
    return np.packbits(codes > 0, axis=1)


def unpack(bits: np.ndarray, dim: int) -> np.ndarray:
    return (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.sqrt(np.float32(dim))


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as int8, scales, lengths of the rounding errors) of rotated unit vectors: the other side of an
    estimate, in an eighth of its bytes."""
    scale = np.maximum(np.abs(turned).max(axis=1), 1e-30) / 127
    q = np.rint(turned / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(turned - q * scale[:, None], axis=1)


def estimate(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded unit vectors and rotated unit vectors."""
    return (codes @ turned.T) / factors[:, None]


def upper(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray, error: np.ndarray | float = 0.0) -> np.ndarray:
    """Certain upper bounds of the same inner products, where `turned` is off by vectors of length `error` at most.

    A coded vector is f * code + sqrt(1 - f^2) * e with e orthogonal to its code, and the product with e is
    bounded by Cauchy-Schwarz.
    """
    s = codes @ turned.T
    f = np.clip(factors, 0, 1)[:, None]
    s = np.minimum(np.clip(s + error, -1, 1), f)  # the bound grows up to s = f, so the largest possible s counts
    return f * s + np.sqrt(1 - f * f) * np.sqrt(1 - s * s)


def possible(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray, error: np.ndarray, least: float, epsilon: float) -> np.ndarray:
    """Whether pairs can reach `least`: by the confidence bound of the estimate, and by the certain bound.

    At an angle t between two vectors the estimate is off by sin(t) * sqrt(1 - f^2) / f times a product of random
    unit vectors in D - 1 dimensions, whose deviation is 1 / sqrt(D - 1). A pair whose estimate is below `least`
    by more than `epsilon` deviations at arccos(least), plus the rounding, is not recomputed: with epsilon = 7 that
    loses a link at `least` with probability 1e-12, and a closer one less likely still. Below 48 dimensions, where
    such a product is not close to normal, the certain bound decides alone.
    """
    slack = least - 1e-4  # rounding of float32
    ok = upper(codes, factors, turned, error[None, :]) >= slack
    if epsilon and codes.shape[1] >= 48:
        f = np.maximum(factors, 1e-6)[:, None]
        ok &= estimate(codes, factors, turned) >= slack - error[None, :] / f - epsilon * np.sqrt(1 - least * least) * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(codes.shape[1] - 1)
    return ok


def usable(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """Rows whose vector is not null, not zero, and has only finite components; the norm in double precision."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    ok = F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return df.where(ok & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), v.alias("v"), norm.alias("norm"))


def links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(members, edges) of all links: pairs with equal labels and cosine >= `least` in double precision.

    members: id, rep (the smallest id with the same label and vector), n_links.
    edges: (a, b) between representatives whose components are those of all links; not all pairs.

    Equal vectors of a label are one class and are never compared. Each class is coded once: the sign bits of its
    rotated vector, their correction factor, and the rotated vector in 8 bits a component for the other side of
    an estimate; these are stored. Classes fall into cells around sampled vectors, large cells are cut into blocks
    by a hash, and two blocks of a label meet only if the angles allow a link (angle between cells <= both radii +
    arccos(least)). First blocks of codes meet; pairs of blocks in which no pair passes the bounds of `possible`
    from both sides go no further. Only for the others the original vectors are fetched, and only pairs that pass
    are recomputed in double precision. Blocks leave counts and a forest of edges, never pairs. Vectors of
    different dimensions do not link.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector, label)
    classes = stored(rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("norm").alias("norm")), "vectors")
    members = rows.join(classes.select(F.col("label").alias("l_"), F.col("v").alias("v_"), "rep", "size"), (F.col("label") == F.col("l_")) & (F.col("v") == F.col("v_"))).select("id", "rep", "size")
    sample = [r[0] for r in classes.orderBy(F.xxhash64("rep", "label")).limit(SAMPLE).select("v").collect()]
    dims = {len(v) for v in sample}
    centres = {}
    for d in dims:
        x = np.array([v for v in sample if len(v) == d], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        picked = [0]
        far = x @ x[0]
        for _ in range(min(CELLS, len(x)) - 1):  # farthest-first: cells that spread over the data
            picked.append(int(far.argmin()))
            far = np.maximum(far, x @ x[picked[-1]])
        centres[d] = x[picked]
    shared = spark.sparkContext.broadcast(centres)
    angle = float(np.arccos(least))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for v, norm in zip(batch.column(1), batch.column(3), strict=True):
                x = np.asarray(v.values) / norm.as_py()
                c = shared.value.get(len(x))
                s = c @ x if c is not None else np.zeros(1)
                k = int(s.argmax())
                turn = turns.setdefault(len(x), rotation(len(x)))
                unit = x[None, :].astype(np.float32)
                code, factor = encode(unit, turn)
                q, scale, error = quantise(unit @ turn)
                row = (k, float(np.arccos(np.clip(s[k], -1, 1))) if c is not None else np.pi, len(x), pack(code)[0].tobytes(), float(factor[0]), q[0].tobytes(), float(scale[0]), float(error[0]))
                for o, y in zip(out, row, strict=True):
                    o.append(y)
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.float32(), pa.binary(), pa.float32(), pa.float32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], names=[*batch.schema.names, "cell", "at", "dim", "code", "factor", "q", "scale", "error"])

    label_type = classes.schema["label"].dataType.simpleString()
    id_type = classes.schema["rep"].dataType.simpleString()
    base = classes.select("label", "v", "rep", "norm", "size")
    coded = f"label {label_type}, v array<double>, rep {id_type}, norm double, size long, cell int, at double, dim int, code binary, factor float, q binary, scale float, error float"
    placed = stored(base.mapInArrow(place, coded), "codes").withColumn("where", F.struct("label", "dim", "cell"))
    n = checkpoint(placed.groupBy("where").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1"))
    cut = attach(placed, n, "where", how="left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("n", F.lit(1))).cast("int"))
    code = F.struct("rep", "size", "code", "factor", "q", "scale", "error")
    blocks = cut.groupBy("label", "dim", "cell", "part").agg(F.max("at").alias("radius"), F.sort_array(F.collect_list(code)).alias("codes"), F.sort_array(F.collect_list(F.struct("rep", "v", "norm"))).alias("vectors"))
    blocks = stored(blocks, "blocks").withColumn("block", F.xxhash64("label", "dim", "cell", "part"))
    heads = blocks.select("label", "dim", "cell", "block", "radius")
    turned = [(d, i, j, float(np.arccos(np.clip(c[i] @ c[j], -1, 1)))) for d, c in centres.items() for i in range(len(c)) for j in range(len(c))]
    apart = spark.createDataFrame(turned or [(0, 0, 0, 0.0)], "d int, i int, j int, apart double")  # at most CELLS^2 rows for a dimension
    left, right = heads.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("i"), F.col("block").alias("b1"), F.col("radius").alias("r1")), heads.select(
        F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("cell").alias("j2"), F.col("block").alias("b2"), F.col("radius").alias("r2")
    )
    near = left.join(F.broadcast(apart.withColumnsRenamed({"d": "dd", "i": "ii"})), (F.col("d") == F.col("dd")) & (F.col("i") == F.col("ii")), "left").join(
        right, (F.col("l") == F.col("l2")) & (F.col("d") == F.col("d2")) & (F.coalesce(F.col("j"), F.lit(0)) == F.col("j2"))
    )
    pairs = near.where((F.col("b1") <= F.col("b2")) & (F.coalesce("apart", F.lit(0.0)) <= F.col("r1") + F.col("r2") + F.lit(angle + 1e-6))).select("b1", "b2", "d")
    one = blocks.select(F.col("block").alias("x1"), F.col("codes").alias("left"))
    two = blocks.select(F.col("block").alias("x2"), F.col("codes").alias("right"))
    met = pairs.join(one, F.col("b1") == F.col("x1")).join(two, F.col("b2") == F.col("x2")).select("b1", "b2", "d", "left", "right")

    def read(codes, dim: int) -> tuple:
        rep, size, code, factor, q, scale, error = (codes.values.field(k) for k in range(7))
        bits = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(rep), -1)
        turned = np.frombuffer(b"".join(q.to_pylist()), np.int8).reshape(len(rep), -1).astype(np.float32) * np.asarray(scale)[:, None]
        return rep, np.asarray(size), unpack(bits, dim), np.asarray(factor), turned, np.asarray(error)

    def gate(l, r, dim: int, same: bool) -> tuple[np.ndarray, tuple, tuple]:
        a, b = read(l, dim), read(r, dim)
        maybe = possible(a[2], a[3], b[4], b[5], least, epsilon) & possible(b[2], b[3], a[4], a[5], least, epsilon).T
        return np.triu(maybe, 1) if same else maybe, a, b

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(gate(l, r, d.as_py(), x == y)[0].any()) for x, y, d, l, r in zip(*(batch.column(k) for k in range(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(3)], names=["b1", "b2", "d"])

    left_over = stored(met.mapInArrow(estimated, "b1 long, b2 long, d int"), "block-pairs")
    one = blocks.select(F.col("block").alias("x1"), F.col("codes").alias("left"), F.col("vectors").alias("left_v"))
    two = blocks.select(F.col("block").alias("x2"), F.col("codes").alias("right"), F.col("vectors").alias("right_v"))
    met = left_over.join(one, F.col("b1") == F.col("x1")).join(two, F.col("b2") == F.col("x2")).select((F.col("b1") == F.col("b2")).alias("same"), "d", "left", "right", "left_v", "right_v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, dim, l, r, lv, rv in zip(*(batch.column(k) for k in range(6)), strict=True):
                maybe, (ia, na, *_), (ib, nb, *_) = gate(l, r, dim.as_py(), same.as_py())
                (xa, ga), (xb, gb) = ((np.asarray(v.values.field(1).flatten()).reshape(len(v.values), -1), np.asarray(v.values.field(2))) for v in (lv, rv))
                i, j = np.nonzero(maybe)
                keep = np.concatenate([np.einsum("ij,ij->i", xa[i[k : k + 65536]], xb[j[k : k + 65536]]) / (ga[i[k : k + 65536]] * gb[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                ra, rb = ia.to_pylist(), ib.to_pylist()
                got_a, got_b = np.bincount(i, nb[j], minlength=len(ra)).astype(np.int64), np.bincount(j, na[i], minlength=len(rb)).astype(np.int64)
                fa_, fb_ = np.flatnonzero(got_a), np.flatnonzero(got_b)
                edges = forest(i, j + (0 if same.as_py() else len(ra)), len(ra) + len(rb))
                names = ra + (ra[:0] if same.as_py() else rb)
                out_a = [ra[k] for k in fa_] + [rb[k] for k in fb_] + [names[x] for x, _ in edges]
                out_b = [None] * (len(fa_) + len(fb_)) + [names[y] for _, y in edges]
                out_n = [*got_a[fa_].tolist(), *got_b[fb_].tolist(), *[0] * len(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(out_a, ia.type), pa.array(out_b, ia.type), pa.array(out_n, pa.int64())], names=["a", "b", "n"])

    found = stored(met.mapInArrow(compare, f"a {id_type}, b {id_type}, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    members = members.join(counts, F.col("rep") == F.col("a"), "left").select("id", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return members, found.where("b is not null").select("a", "b")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links i-j over n nodes: one edge from each node to the least node it reaches."""
    top = np.arange(n)
    while True:
        before = top.copy()
        low = np.minimum(top[i], top[j])
        np.minimum.at(top, i, low)
        np.minimum.at(top, j, low)
        top = top[top]
        if (top == before).all():
            return [(x, y) for x, y in enumerate(top.tolist()) if x != y]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, epsilon: float = EPSILON) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df. Rows without a label or a usable vector link with
    nothing; a row with a null id has a null component. Rows that repeat an id get the most links and the
    least component of any of them. An empty table gives an empty result."""
    members, edges = links(df, id_col, vector, label, least, epsilon)
    comp = components(edges)
    full = members.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("id_"), "n_links", F.coalesce("component", "rep").alias("component")).groupBy("id_").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    rows = df.select(F.col(id_col).alias("id")).join(full, F.col("id") == F.col("id_"), "left")
    c = F.coalesce("component", "id")
    return rows.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), (c == F.col("id")).alias("kept"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.x JOIN c ON vec_id = c.x
"""
