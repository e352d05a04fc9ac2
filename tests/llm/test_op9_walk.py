"""What keeps op9's work in proportion to its table: few rounds, no pair met twice, shards of bounded size."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wavelake.llm import nn_descent


def test_pairs_that_have_met_do_not_meet_again(spark):
    points = spark.createDataFrame([(i, np.array([math.cos(0.1 * i), math.sin(0.1 * i)], np.float16).tobytes()) for i in range(5)], "id bigint, h binary")
    links = [(0, i, math.cos(0.1 * i), False) for i in range(1, 5)]
    schema = "id bigint, nb bigint, sim double, fresh boolean"
    assert nn_descent.local_join(spark.createDataFrame(links, schema), points, 2).count() == 0
    links[3] = (*links[3][:3], True)
    last = spark.createDataFrame([*links, *((i, 0, s, False) for _, i, s, _ in links[:3]), (4, 0, links[3][2], True)], schema)
    found = {(r.id, r.nb) for r in nn_descent.local_join(last, points, 2).collect()}
    assert found == {(i, 4) for i in range(1, 4)} | {(4, i) for i in range(1, 4)}


def test_few_rounds(spark, monkeypatch):
    """The first graph is so near to its end that few rounds follow."""
    x = np.random.default_rng(5).standard_normal((6000, 64))
    turns, join = [], nn_descent.local_join
    monkeypatch.setattr(nn_descent, "local_join", lambda *a: turns.append(a[3]) or join(*a))
    table = spark.createDataFrame(pa.table({"id": pa.array(range(len(x)), pa.int64()), "v": pa.array(x.tolist(), pa.list_(pa.float64()))}))
    links = nn_descent.build_graph(table.repartition(8)).toArrow()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = (links.column(c).to_numpy() for c in ("id", "nb"))
    right = sum(len(set(b[a == q]) & set(np.argsort(-(unit @ unit[q]))[1:6])) for q in range(0, 6000, 50))
    print(f"rounds {len(turns)}, recall of the lists {right / 600:.3f}")
    assert len(turns) <= 4 and right >= 0.75 * 600


def test_shards_are_bounded_and_whole(spark):
    """Also for ids that are negative or have a common factor."""
    x = np.random.default_rng(6).standard_normal((3000, 24))
    ids = (np.arange(3000) - 1500) * 64 * 50
    table = spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))
    nodes = nn_descent.valid_vectors(table).withColumnRenamed("vec_id", "id")
    ring = nodes.select("id", F.when(F.col("id") < 1499 * 3200, F.col("id") + 3200).otherwise(F.lit(-1500 * 3200)).alias("nb"))
    vectors, linked, shards = nn_descent.sharded(nodes, ring, 3000, 24)
    sizes = [r.n for r in vectors.select(F.size("ids").alias("n")).collect()]
    assert len(sizes) <= shards and sum(sizes) == 3000 and max(sizes) <= 4 * 3000 / shards
    assert linked.agg(F.sum(F.size("nbs"))).first()[0] == 6000
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    right = 0
    for r in nn_descent.nearest(table.where("vec_id % 50 = 0"), F.col("vec_id") % 160_000 == 0).collect():
        at = r.query_id // 3200 + 1500
        best = np.sort(unit @ unit[at])[-6:]
        right += r.score >= best[0] - 1e-12
    assert right >= 0.92 * 5 * 60
