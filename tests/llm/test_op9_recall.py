"""The graph and the walk of op9 on more than a walk of bounded length sees."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelake.llm import nn_descent


def test_hub(spark):
    """All reverse neighbours of a hub meet its own neighbour, not the first chunk of them alone."""
    angle = {0: 0.0, 1: 3.0, **{i: 0.001 * i for i in range(2, 102)}}
    points = spark.createDataFrame([(i, np.array([math.cos(a), math.sin(a)], np.float16).tobytes()) for i, a in angle.items()], "id bigint, h binary")
    links = [(0, 1), (1, 0), *((i, 0) for i in range(2, 102))]
    graph = spark.createDataFrame([(a, b, math.cos(angle[a] - angle[b])) for a, b in links], "id bigint, nb bigint, sim float")
    found = {(r.id, r.nb) for r in nn_descent.local_join(graph, points, 2).collect()}
    assert {(i, 1) for i in range(2, 102)} | {(1, i) for i in range(2, 102)} <= found


def fifths(ids, x):
    """The fifth-best cosine of each query, itself left out."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    best = {}
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        s = unit @ unit[q]
        s[q] = -2
        best[int(ids[q])] = np.sort(s)[-5]
    return best


def vectors(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))})).repartition(8)


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12_000 if kind == "gaussian" else 6000, 32))
    if kind == "clustered":  # clusters of 5 to 500 rows, far apart
        centre = rng.standard_normal((100, 32)) * 8
        x += centre[rng.choice(100, len(x), p=np.arange(1, 101) / 5050)]
    want = fifths(np.arange(len(x)), x)
    got = nn_descent.nearest(vectors(spark, x), F.col("vec_id") % 50 == 0).collect()
    right = sum(r.score >= want[r.query_id] - 1e-12 for r in got)
    print(f"recall {right / 5 / len(want):.4f}")
    assert right >= 0.92 * 5 * len(want)


def test_pool_grows_until_the_recall_is_reached(spark, monkeypatch):
    """With a pool far too small to begin with."""
    monkeypatch.setattr(nn_descent, "NEIGHBOURS", 4)
    x = np.random.default_rng(3).standard_normal((1500, 24))
    want = fifths(np.arange(len(x)), x)
    vectors_ = nn_descent.valid_vectors(vectors(spark, x))
    nodes = vectors_.withColumnRenamed("vec_id", "id").cache()
    asked = nodes.where("id % 50 = 0").withColumnRenamed("id", "q")
    found = nn_descent.greedy_search(asked, nodes, nn_descent.build_graph(nodes), 5, pool_size=6)
    best = nn_descent.best_of(found.where("q <> c"), "q", [F.desc("s"), "c"], 5).collect()
    assert sum(r.s >= want[r.q] - 1e-12 for r in best) >= 0.88 * 5 * len(want)


def test_exact(spark):
    x = np.random.default_rng(4).standard_normal((2500, 16))
    x[7], x[100] = x[50], x[150]
    want = fifths(np.arange(len(x)), x)
    got = nn_descent.nearest(vectors(spark, x), F.col("vec_id") % 50 == 0, exact=True).collect()
    assert len(got) == 5 * len(want) and all(r.score >= want[r.query_id] - 1e-12 for r in got)
    assert {(r.query_id, r.rank): r.vec_id for r in got}[50, 1] == 7


def test_entries_serve_few_queries(spark):
    asked = spark.range(5000).select(F.col("id").alias("q"))
    rows = nn_descent.entries_of(asked, 5000)
    assert rows.groupBy("c").count().agg(F.max("count")).first()[0] <= nn_descent.ENTRIES + 1
    assert rows.groupBy("q").count().agg(F.min("count")).first()[0] > 8 and rows.where("q = c").count() == 5000
    assert nn_descent.entries_of(asked.limit(1), 1).count() == 1


def test_clashing_columns_and_repeated_ids(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    clash = table.withColumns({c: F.lit(1) for c in ("q", "c", "v", "norm", "s", "id", "rank", "score", "r_")})
    rows = nn_descent.nearest(clash, F.col("vec_id") % 50 == 0).where("rank = 1").collect()
    assert {(r.query_id, r.vec_id) for r in rows} == {(0, 1)}
