"""Recall of the nearest neighbours where one vector is far longer than the others."""

import numpy as np
import pytest

from lexspark.llm import neighbours

from .test_ops import VECTORS, brute_nearest


@pytest.mark.parametrize("times", [100, 1000])
def test_recall_beside_one_long_vector(spark, times):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= times
    df = spark.createDataFrame([(i, [float(t) for t in v], 0, "") for i, v in enumerate(x)], VECTORS)
    got = neighbours.nearest(df, df.where("vec_id % 12 = 0")).toPandas()
    fine = [(i, x[i].astype(float)) for i in range(len(x))]
    want = brute_nearest(fine, [f for f in fine if f[0] % 12 == 0], 20)
    found = got.groupby("query_id").id.apply(set).to_dict()
    assert np.mean([len(found[q] & set(want[q])) / 20 for q in want]) >= 0.95


def test_foreign_queries_and_hubs(spark):
    """Queries that are no node of the graph, on a table in which a few nodes are neighbours of a thousand others."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[:5] = x.mean(axis=0) + 0.1 * rng.standard_normal((5, 16))  # hubs in the middle
    x[5:1000] *= 0.2
    q = rng.standard_normal((60, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(t) for t in v], 0, "") for i, v in enumerate(x)], VECTORS)
    asked = spark.createDataFrame([(5000 + i, [float(t) for t in v], 0, "") for i, v in enumerate(q)], VECTORS)
    got = neighbours.nearest(df, asked).toPandas().groupby("query_id").id.apply(set).to_dict()
    want = brute_nearest([(i, x[i].astype(float)) for i in range(1500)], [(5000 + i, v.astype(float)) for i, v in enumerate(q)], 20)
    assert np.mean([len(got[k] & set(want[k])) / 20 for k in want]) >= 0.9


def test_exact_blocks(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((300, 8))
    rows = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    asked = rows.where("id % 50 = 0").selectExpr("id AS q", "v AS qv")
    got = neighbours.exact(rows, asked, 20, most=4).orderBy("query_id", "rank").collect()
    want = brute_nearest(list(enumerate(x)), [(i, x[i]) for i in range(0, 300, 50)], 20)
    assert all([r.id for r in got if r.query_id == i] == want[i] for i in want)
    assert neighbours.exact(rows, asked.limit(0), 20) is None
