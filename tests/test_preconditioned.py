"""Preconditioned descent against plain versions: a two-loop recursion on arrays, conjugate gradients, the forcing rule."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.plans import descent

def scale():
    return F.pow(F.lit(3.0), F.col("i"))


def objective(point):
    made = point.select("i", (scale() * (F.col("v") - F.col("i"))).alias("grad"), (scale() * F.pow(F.col("v") - F.col("i"), F.lit(2.0)) / 2).alias("l"))
    return float(made.agg(F.sum("l")).first()[0]), made.select("i", "grad")


def scaled(table):
    return table.select("i", (F.col("g") / scale()).alias("pg"))


def product(at, direction):
    return direction.select("i", (scale() * F.col("d")).alias("hd"))


def start(spark):
    return spark.range(6).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


def test_preconditioned_lbfgs_direction(spark):
    rng = np.random.default_rng(5)
    n, memory = 7, 3
    g, s = rng.normal(size=n), rng.normal(size=(memory, n))
    y = s * np.linspace(1, 4, n)
    p = np.linspace(0.5, 2, n)
    q, alphas = g.copy(), []
    for k in reversed(range(memory)):
        alphas.append(s[k] @ q / (s[k] @ y[k]))
        q -= alphas[-1] * y[k]
    d = s[-1] @ y[-1] / (y[-1] @ y[-1]) * p * q
    for k, alpha in zip(range(memory), reversed(alphas), strict=True):
        d += (alpha - y[k] @ d / (s[k] @ y[k])) * s[k]
    names = ["i", "g", *(f"{c}{k}" for k in range(memory) for c in "sy")]
    table = spark.createDataFrame([(i, float(g[i]), *(float(x[k][i]) for k in range(memory) for x in (s, y))) for i in range(n)], names)
    weight = 0.5 + F.col("i") * (1.5 / (n - 1))
    made = descent.preconditioned_lbfgs(table, memory, lambda t: t.select("i", (weight * F.col("g")).alias("pg")))
    assert np.allclose([r.d for r in made.orderBy("i").collect()], -d)
    assert np.allclose([-x for x in descent.preconditioned_lbfgs(table.select("i", "g"), 0, lambda t: t.withColumnRenamed("g", "pg")).orderBy("i").select("d").toPandas()["d"]], g)


@pytest.mark.parametrize(("method", "how"), [("newton", {"product": product, "inner": 8}), ("newton", {"product": product, "precondition": scaled, "inner": 2}), ("lbfgs", {"precondition": scaled})])
def test_preconditioned_minimise(spark, method, how):
    found, losses = descent.minimise(objective, start(spark), method, iterations=6, tolerance=1e-10, **how)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 1e-3 * losses[0]
    if method == "newton" and "precondition" in how:  # the exact inverse: one step
        assert len(losses) == 2 and all(math.isclose(r.v, r.i, abs_tol=1e-9) for r in found.collect())


def test_preconditioned_newton_stops_at_negative_curvature(spark):
    table = spark.range(3).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("g"))
    made = descent.newton_direction(table, lambda t: t.select("i", (-F.col("d")).alias("hd")), precondition=scaled)
    for r in made.collect():
        assert math.isclose(r.d, -(r.i + 1.0) / 3.0**r.i) and r.r == r.i + 1.0


def test_forcing_term(spark):
    grad = spark.createDataFrame([(0, 3.0), (1, 4.0)], "i bigint, grad double")
    left = spark.createDataFrame([(0, 0.0), (1, 0.0)], "i bigint, r double")
    assert math.isclose(descent.forcing_term(grad, left, 10.0, 0.01), 0.5)
    assert math.isclose(descent.forcing_term(grad, left, 100.0, 0.9), 0.9 ** ((1 + 5**0.5) / 2))
    assert descent.forcing_term(grad, left, 1.0, 0.01) == 0.9


def test_minimise_refuses_what_it_cannot_do(spark):
    with pytest.raises(ValueError, match="product"):
        descent.minimise(objective, start(spark), "newton")
    with pytest.raises(ValueError, match="preconditioner"):
        descent.minimise(objective, start(spark), "cg", precondition=scaled)
