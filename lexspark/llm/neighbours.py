"""Approximate nearest neighbours: NN-descent builds the graph, greedy graph search answers queries."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpoint, stored, table

#: Neighbours of a node in the graph; members of a local join; candidates a node gets from one local join.
K, MEMBERS, GAIN = 32, 96, 8
#: Nodes of a block of the first, random-projection graph; number of such partitions; rounds of descent.
BLOCK, TABLES, ROUNDS = 256, 2, 6
#: A query's pool, nodes it expands in a hop, hops, and entry nodes it starts from (out of ENTRIES for all).
POOL, EXPAND, HOPS, STARTS, ENTRIES = 96, 48, 8, 8, 1024


def usable(vector: str) -> tuple[Column, Column]:
    """(vector in double precision, whether it takes part): not null, not zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v, F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def best(u: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best distinct candidates c of each u (by score, ties to the smaller id)."""
    order = np.lexsort((c, -s, u))
    u, c = u[order], c[order]
    _, first = np.unique(np.stack([u, c]), axis=1, return_index=True) if len(u) else (None, np.zeros(0, int))
    keep = np.zeros(len(u), bool)
    keep[first] = True
    order, u = order[keep], u[keep]
    start = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1]) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(start, np.diff(np.concatenate([start, [len(u)]])))
    return order[rank < k]


def encoded(x: np.ndarray) -> list[bytes]:
    """A code of each row: its own scale in double precision, then 16 bits a component, so that no other row coarsens it."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 32767
    q = np.rint(x / scale[:, None]).astype(np.int16)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, q, strict=True)]


def decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(scales, components in steps of 1/32767 of the row's largest) of codes."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0] * 32767
    return scale, np.ascontiguousarray(raw[:, 8:]).view(np.int16).astype(np.float32) / np.float32(32767)


def closeness(codes: list[bytes]) -> np.ndarray:
    """Minus the squared distances of the reduction below between all rows: the order of its cosines, but without
    their loss of digits where all norms are far below the largest."""
    scale, x = decoded(codes)
    dot = (x @ x.T).astype(np.float64) * scale[:, None] * scale[None, :]
    n = np.diag(dot)
    a = np.sqrt(np.maximum(0, 1 - n))
    rest = (n[:, None] - n[None, :]) / np.maximum(a[:, None] + a[None, :], 1e-150)
    return -(n[:, None] + n[None, :] - 2 * dot + rest * rest)


class Index:
    """nodes: id, code (the vector over the largest norm, by `encoded`); graph: id, nbs, scores.

    Inner products become cosines by one more component: x -> (x, sqrt(M^2 - |x|^2)) / M with M the largest
    norm, q -> (q, 0) / |q|. The component is not stored: it follows from the norm. Equal vectors are one node,
    represented by their smallest id.
    """

    def __init__(self, nodes: DataFrame, graph: DataFrame, norm: float):
        self.nodes, self.graph, self.norm = nodes, graph, norm


def build(classes: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 42) -> Index:
    """NN-descent over (id, v): distinct usable vectors.

    Random projections deal the nodes into blocks of about BLOCK, whose exact neighbours are the first
    lists. In a round, every node is the pivot of a local join: its neighbours and reverse neighbours (of the
    latter all up to MEMBERS, then a hash sample, so no hub gathers an unbounded group) meet each other, and
    what improves on a list is sent to it. Pairs of which both were there in the last round are skipped.
    Rounds end when fewer than 0.2 % of the list entries change.
    """
    spark = classes.sparkSession
    top = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    n, norm, dim = top[0], float(top[1] or 1.0) ** 0.5, top[2] or 1
    rng = np.random.default_rng(seed)
    bits = max(0, ceil(log2(max(1, n / BLOCK))))
    planes = [rng.standard_normal((dim, max(1, bits))).astype(np.float32) for _ in range(TABLES)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(x.values) for x in batch.column(1)]
            x = np.zeros((len(rows), dim))
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            x /= norm
            cells = [((x @ p > 0) @ (1 << np.arange(p.shape[1]))).astype(np.int64) if bits else np.zeros(len(x), np.int64) for p in planes]
            cells = np.stack(cells, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encoded(x), pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), TABLES).cast(pa.list_(pa.int64()))],
                names=["id", "code", "cells"],
            )

    id_type = classes.schema["id"].dataType.simpleString()
    coded = stored(classes.select("id", "v").mapInArrow(code, f"id {id_type}, code binary, cells array<long>"), "ann-nodes")
    nodes = coded.select("id", "code")
    dealt = coded.select("id", "code", F.posexplode("cells").alias("t", "cell"))
    size = checkpoint(dealt.groupBy("t", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts")).where("parts > 1")).withColumnsRenamed({"t": "t_", "cell": "cell_"})
    dealt = dealt.join(size, (F.col("t") == F.col("t_")) & (F.col("cell") == F.col("cell_")), "left")
    groups = dealt.groupBy("t", "cell", F.pmod(F.xxhash64("id", "t"), F.coalesce("parts", F.lit(1))).alias("part")).agg(F.collect_list(F.struct("id", "code", F.lit(float("-inf")).cast("float").alias("worst"), F.lit(True).alias("new"))).alias("members"))
    found = groups.select("members").mapInArrow(_local_join(k, id_type), f"u {id_type}, c {id_type}, s float")
    graph = _merge(nodes.select("id", F.array().cast(f"array<{id_type}>").alias("nbs"), F.array().cast("array<float>").alias("scores"), F.array().cast("array<boolean>").alias("new")), found, k, id_type)
    for _ in range(rounds):
        edges = graph.select("id", F.inline(F.arrays_zip("nbs", "new")))
        own = edges.select(F.col("id").alias("p"), F.col("nbs").alias("m"), "new")
        reverse = _sampled(edges.select(F.col("nbs").alias("p"), F.col("id").alias("m"), "new"), "p", "m")
        kept = own.unionByName(reverse).groupBy("p", "m").agg(F.max("new").alias("new"))
        worst = graph.select(F.col("id").alias("m_"), F.when(F.size("scores") < k, F.lit(float("-inf")).cast("float")).otherwise(F.array_min("scores")).alias("worst"))
        info = nodes.withColumnRenamed("id", "n_").join(worst, F.col("n_") == F.col("m_")).select("m_", "code", "worst")
        met = kept.join(info, F.col("m") == F.col("m_")).groupBy("p").agg(F.collect_list(F.struct(F.col("m").alias("id"), "code", "worst", "new")).alias("members")).where(F.exists("members", lambda x: x["new"]))
        found = met.select("members").mapInArrow(_local_join(GAIN, id_type), f"u {id_type}, c {id_type}, s float")
        graph = _merge(graph, found, k, id_type)
        if (graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0) < 0.002 * n * k:
            break
    return Index(nodes, graph, norm)


def _sampled(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges into a node: all of them up to MEMBERS, beyond that a hash sample of about so many. A node's own
    list is never sampled, so a hub keeps its neighbours."""
    hubs = edges.groupBy(node).count().where(F.col("count") > MEMBERS).select(F.col(node).alias("hub_"), "count")
    some = F.pmod(F.xxhash64(node, other), F.lit(1 << 20)) * F.col("count") < F.lit(MEMBERS << 20)
    return edges.join(hubs, F.col(node) == F.col("hub_"), "left").where(F.col("count").isNull() | some).drop("hub_", "count")


def _local_join(most: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, cs, ss = [], [], []
            for g in batch.column(0):
                ids, codes, worst, new = (g.values.field(k) for k in range(4))
                ids, worst, new = np.asarray(ids), np.asarray(worst), np.asarray(new)
                n = len(ids)
                if n < 2:
                    continue
                s = closeness(codes.to_pylist()).astype(np.float32)
                bad = ids[:, None] == ids[None, :]
                if not new.all():
                    bad |= ~(new[:, None] | new[None, :])
                s[bad] = -np.inf
                s[s <= worst[:, None]] = -np.inf
                m = min(most, n - 1)
                part = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (n, 1))
                val = np.take_along_axis(s, part, axis=1)
                i, j = np.nonzero(val > -np.inf)
                us.append(ids[i])
                cs.append(ids[part[i, j]])
                ss.append(val[i, j])
            if us:
                u, c, s = np.concatenate(us), np.concatenate(cs), np.concatenate(ss)
                keep = best(u, c, s, K)  # a task combines what it sends to a node
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(c[keep]), pa.array(s[keep])], names=["u", "c", "s"])

    return run


def _merge(graph: DataFrame, found: DataFrame, k: int, id_type: str) -> DataFrame:
    """The k best of a node's list and of what was found for it; `new` marks what was not in the list."""
    per = found.groupBy("u").agg(F.collect_list("c").alias("cs"), F.collect_list("s").alias("ss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbs, scores, new = [], [], []
            for row in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                a, s, c, t = (np.asarray(x.values) if x.is_valid else np.zeros(0) for x in row)
                ids = np.concatenate([a, c]).astype(np.int64)
                val = np.concatenate([s, t]).astype(np.float32)
                keep = best(np.zeros(len(ids), np.int64), ids, val, k)
                nbs.append(ids[keep])
                scores.append(val[keep])
                new.append(~np.isin(ids[keep], a.astype(np.int64)))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nbs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (nbs, scores, new))], names=["id", "nbs", "scores", "new"])

    rows = graph.join(per, F.col("id") == F.col("u"), "left").select("id", "nbs", "scores", "cs", "ss")
    return stored(rows.mapInArrow(run, f"id {id_type}, nbs array<{id_type}>, scores array<float>, new array<boolean>"), "ann-graph")


def search(index: Index, queries: DataFrame, pool: int = POOL, hops: int = HOPS) -> DataFrame:
    """(q, pool): for each row (q, qv, own) the best nodes met, as array of ids.

    Every query starts from the best of ENTRIES hash-sampled nodes (a fixed bound, broadcast) and from `own`,
    a node known to be near it, if not null. In a hop it expands the best EXPAND nodes of its pool that it
    has not yet expanded, over forward and reverse edges; the search ends when no pool changes.
    """
    spark = queries.sparkSession
    id_type = index.nodes.schema["id"].dataType.simpleString()
    sample = index.nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()
    names = np.array([r[0] for r in sample], dtype=np.int64)
    scale, codes = decoded([bytes(r[1]) for r in sample]) if sample else (np.zeros(0), np.zeros((0, 1), np.float32))
    shared = spark.sparkContext.broadcast((names, scale, codes))

    def vector(x, dim: int) -> np.ndarray:
        v = np.asarray(x.values, dtype=np.float64)[:dim]
        return (np.concatenate([v, np.zeros(dim - len(v))]) / max(np.linalg.norm(v), 1e-300)).astype(np.float32)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scale, codes = shared.value
        for batch in batches:
            ids, scores = [], []
            for v, own in zip(batch.column(1), batch.column(2), strict=True):
                s = scale * (codes @ vector(v, codes.shape[1]))
                at = np.argsort(-s)[:STARTS]
                first = [own.as_py()] if own.is_valid else []
                ids.append([*first, *[i for i in names[at].tolist() if i not in first]])
                scores.append([float("inf")] * len(first) + [float(x) for i, x in zip(names[at].tolist(), s[at].tolist(), strict=True) if i not in first])
            done = [[False] * len(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32())), pa.array(done, pa.list_(pa.bool_()))], names=["q", "qv", "ids", "scores", "done"])

    state_type = f"q long, qv array<double>, ids array<{id_type}>, scores array<float>, done array<boolean>"
    state = stored(queries.select("q", "qv", "own").mapInArrow(start, state_type), "ann-pool")
    edges = index.graph.select("id", F.explode("nbs").alias("nb"))
    both = edges.unionByName(_sampled(edges.select(F.col("nb").alias("id"), F.col("id").alias("nb")), "id", "nb")).distinct()
    adjacent = stored(both.groupBy("id").agg(F.collect_list("nb").alias("to")), "ann-adjacent")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for qv, ids, scores, done, got in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                ids, scores, done = np.asarray(ids.values), np.asarray(scores.values), np.array(done.as_py(), bool)
                now = np.argsort(np.where(done, np.inf, -scores), kind="stable")[:EXPAND]
                done[now] = True  # the same choice as the explode that led here
                moved = False
                if got.is_valid and len(got.values):
                    new, code = np.asarray(got.values.field(0)), got.values.field(1)
                    fresh_ = ~np.isin(new, ids)
                    scale, x = decoded(code.to_pylist())
                    s = scale * (x @ vector(qv, x.shape[1]))
                    ids = np.concatenate([ids, new[fresh_]])
                    scores = np.concatenate([scores, s[fresh_]]).astype(np.float32)
                    done = np.concatenate([done, np.zeros(int(fresh_.sum()), bool)])
                    at = np.argsort(-scores, kind="stable")[:pool]
                    moved = bool((~done[at]).any())
                    ids, scores, done = ids[at], scores[at], done[at]
                for o, x in zip(out, (ids, scores, done, moved), strict=True):
                    o.append(x)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out[0]])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in out[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(out[3], pa.bool_())], names=["q", "qv", "ids", "scores", "done", "moved"])

    for _ in range(hops):
        open_ = F.filter(F.arrays_zip("ids", "scores", "done"), lambda x: ~x["done"])
        now = F.slice(F.array_sort(open_, lambda a, b: F.when(a["scores"] > b["scores"], -1).when(a["scores"] < b["scores"], 1).otherwise(0)), 1, EXPAND)
        grown = state.select("q", F.explode(now).alias("x")).select("q", F.col("x.ids").alias("node"))
        reached = grown.join(adjacent, F.col("node") == F.col("id")).select("q", F.explode("to").alias("c")).distinct()
        known = state.select(F.col("q").alias("q_"), F.explode("ids").alias("c_"))
        reached = reached.join(known, (F.col("q") == F.col("q_")) & (F.col("c") == F.col("c_")), "left_anti")
        scored = reached.join(index.nodes, F.col("c") == F.col("id")).groupBy(F.col("q").alias("q_")).agg(F.collect_list(F.struct("c", "code")).alias("got"))
        state = stored(state.drop("moved").join(scored, F.col("q") == F.col("q_"), "left").select("q", "qv", "ids", "scores", "done", "got").mapInArrow(step, state_type + ", moved boolean"), "ann-pool")
        if not state.where("moved").limit(1).count():
            break
    return state.select("q", "qv", F.col("ids").alias("pool"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of `vectors` found for each row of `queries`, by inner
    product in double precision, ties to the smaller id; a row with the query's own id is no candidate.

    Null, zero and non-finite vectors take no part on either side; queries without candidates have no rows.
    Equal vectors are one node: of each, the k + 1 smallest ids are kept aside (in salted steps), which is
    all a query can return of them. Rows that repeat an id count once. Scores are recomputed from the
    original vectors. A query that the graph search leaves with fewer rows than there are candidates for is
    answered by `exact`.
    """
    v, ok = usable(vector)
    rows = vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).dropDuplicates(["id"])
    rows = stored(rows, "ann-rows")
    salt = rows.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = salt.withColumn("r", F.row_number().over(W.partitionBy("h", "v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = stored(few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members")), "ann-classes")
    index = build(classes.select("id", "v"))
    asked = queries.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), v.alias("qv")).dropDuplicates(["q"])
    own = classes.select(F.col("v").alias("v_"), F.col("id").alias("own"))
    pools = search(index, asked.join(own, F.col("qv") == F.col("v_"), "left"))
    met = pools.select("q", "qv", F.explode("pool").alias("node")).join(classes, F.col("node") == F.col("id"))
    score = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    each = met.select("q", score.alias("score"), F.explode("members").alias("id")).where("id != q")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = stored(each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score"), "ann-found")
    n = rows.count()
    full = found.groupBy("query_id").count().select(F.col("query_id").alias("full_"), F.col("count").alias("met"))
    short = asked.join(full, F.col("q") == F.col("full_"), "left").join(rows.select(F.col("id").alias("own_")), F.col("q") == F.col("own_"), "left")
    short = checkpoint(short.where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own_").isNotNull().cast("long"))).select("q", "qv"))
    again = exact(rows, short, k)
    return found if again is None else found.join(short.select(F.col("q").alias("q_")), F.col("query_id") == F.col("q_"), "left_anti").unionByName(again)


def exact(rows: DataFrame, asked: DataFrame, k: int, most: int = 4096) -> DataFrame | None:
    """(query_id, rank, id, score): the k best of all rows (id, v) for the queries (q, qv); None without queries.

    Queries go to the rows in hash parts of about `most`, a fixed bound on what is broadcast; a task keeps the best
    of each of its batches only.
    """
    parts = -(-asked.count() // most)
    out = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        dim = max((len(r.qv) for r in some), default=0)
        x = np.zeros((len(some), dim))
        for i, r in enumerate(some):
            x[i, : len(r.qv)] = r.qv
        shared = asked.sparkSession.sparkContext.broadcast((np.array([r.q for r in some], np.int64), x))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, x = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows if len(names) else 0, 512):
                    b = batch.slice(at, 512)
                    ids, y = b.column(0).to_numpy(), np.zeros((b.num_rows, x.shape[1]))
                    for i, v in enumerate(b.column(1)):
                        v = np.asarray(v.values)[: x.shape[1]]
                        y[i, : len(v)] = v
                    s = x @ y.T
                    s[names[:, None] == ids[None, :]] = -np.inf
                    i, j = (g.ravel() for g in np.indices(s.shape))
                    keep = best(i, ids[j], s.ravel(), k)
                    keep = keep[s.ravel()[keep] > -np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[keep]]), pa.array(ids[j[keep]])], names=["q", "id"])

        near = rows.select("id", "v").mapInArrow(run, "q long, id long")
        near = near.join(asked.select(F.col("q").alias("q_"), "qv"), F.col("q") == F.col("q_")).join(rows.select(F.col("id").alias("id_"), "v"), F.col("id") == F.col("id_"))
        each = near.select("q", "id", F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x).alias("score"))
        each = each.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        each = each.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score")
        out = each if out is None else out.unionByName(each)
    return out


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")
