"""Kernels and plans against closed forms, enumeration and finite differences."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import rock
from wavelake.operators import adjoint, grid, metrics, misfit, optimise
from wavelake.plans import descent
from wavelake.sources import views
from wavelake.streaming import shots as streaming


def test_fd_coefficients():
    assert np.allclose(grid.fd_coefficients(2), [9 / 8, -1 / 24])
    assert np.allclose(grid.fd_coefficients(3), [75 / 64, -25 / 384, 3 / 640])
    assert np.allclose(grid.fd_coefficients(1, staggered=False), [0.5])


def test_lag_and_analytic():
    x = np.zeros(50)
    x[10] = 1
    obs, syn = np.stack([x, x, x * 0]), np.stack([np.roll(x, 7), np.roll(x, -4), x])
    assert misfit.lag_of(obs, syn).tolist() == [7, -4, 0]
    t = np.arange(400)
    assert np.allclose(np.abs(misfit.analytic(np.cos(2 * np.pi * t / 20)))[100:300], 1, atol=0.01)


def paths(n, m):
    def grow(i, j):
        if (i, j) == (n - 1, m - 1):
            yield [(i, j)]
        for a, b in ((1, 0), (0, 1), (1, 1)):
            if i + a < n and j + b < m:
                for rest in grow(i + a, j + b):
                    yield [(i, j), *rest]

    return grow(0, 0)


def test_soft_dtw_by_enumeration():
    x, y, gamma = np.array([0.1, 0.5, -0.3, 0.2]), np.array([0.0, 0.4, 0.1]), 0.7
    costs = np.array([sum((x[i] - y[j]) ** 2 for i, j in p) for p in paths(4, 3)])
    assert np.allclose(misfit.soft_dtw_value(np.stack([x, x]), np.stack([y, y]), gamma), -gamma * math.log(np.exp(-costs / gamma).sum()), rtol=1e-9)


def test_transport():
    t = np.arange(5.0)
    a, b = np.array([1.0, 0, 0, 0, 0]) + 1e-18, np.array([0.0, 0, 0, 1, 0]) + 1e-18
    assert np.allclose(misfit.wasserstein_of(np.stack([a, a]), np.stack([b, a]), t, 2), [9, 0], rtol=1e-9)
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((5, 2)), rng.standard_normal((5, 2))
    exact = min(sum(((x[i] - y[p[i]]) ** 2).sum() / 2 for i in range(5)) / 5 for p in itertools.permutations(range(5)))
    both = misfit.sinkhorn_cost(np.stack([x, x]), np.stack([y, x]), 2, 0.02, 0.5)
    assert math.isclose(both[0], exact, rel_tol=0.05) and abs(both[1]) < 0.01 and math.isclose(misfit.sinkhorn_cost(x[None], y[None], 2, 0.02, 0.5)[0], both[0], rel_tol=1e-9)


def test_sinkhorn_says_if_it_does_not_settle(monkeypatch):
    monkeypatch.setattr(misfit, "MOST_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        misfit.sinkhorn_cost(np.zeros((1, 2, 2)), np.ones((1, 2, 2)) * 9, 2, 0.1, 0.5)


def test_kernels_of_mixed_lengths(spark):
    """Pairs of other lengths, nulls and empty traces in one batch."""
    rows = [(0, 0, [1.0, 2.0], [0.0, 1.0, 2.0]), (0, 1, None, [1.0]), (0, 2, [], [1.0]), (1, 3, [1.0, 0.0], [0.0, 1.0])]
    pairs = spark.createDataFrame(rows, "shot bigint, rcv bigint, obs array<double>, syn array<double>").coalesce(1)
    assert {r.rcv: r.lag for r in misfit.travel_times(pairs).collect()} == {0: 1.0, 1: None, 2: None, 3: 1.0}
    assert {r.shot: r.misfit for r in misfit.travel_time(pairs).collect()} == {0: 0.5, 1: 0.5}


def test_tiles(spark, monkeypatch):
    """Neighbours across tiles' borders, for tiles far smaller than the grid."""
    cells = spark.range(17 * 23).select((F.col("id") % 17).alias("iz"), F.floor(F.col("id") / 17).alias("ix"), F.sin(F.col("id") * 1.7).alias("v"))
    made = lambda: [
        sorted(map(tuple, grid.local(cells, 5, lambda t: t.select("iz", "ix", "tz_", "tx_", *(grid.staggered_difference("v", a, f, 10).alias(f"{a}{f}") for a in "xz" for f in (True, False)))).collect()), key=repr),
        grid.tikhonov(cells, 2).first()[0], grid.total_variation(cells).first()[0], metrics.roughness(cells).first()[0],
        sorted(map(tuple, grid.staggered_means(cells.withColumns({"b": F.col("v"), "mu": F.col("v")})).collect()), key=repr),
        metrics.ssim(cells.select(F.lit(1).alias("iter"), "iz", "ix", "v", (F.col("v") + 0.1 * F.col("iz")).alias("t"))).first().ssim,
    ]
    whole = made()
    monkeypatch.setattr(grid, "SIDE", 6)
    cut = made()
    assert cut[0] == whole[0] and cut[4] == whole[4] and np.allclose([cut[k] for k in (1, 2, 3, 5)], [whole[k] for k in (1, 2, 3, 5)])


@pytest.mark.parametrize("name", ["l1", "l2", "smooth_l1", "student_t"])
@pytest.mark.parametrize("peaks", [False, True])
def test_adjoint_sources(spark, name, peaks):
    """Each sample's derivative against central differences of the misfit; one trace is dead."""
    rng = np.random.default_rng(5)
    obs, syn = rng.standard_normal((3, 12)), rng.standard_normal((3, 12))
    syn[2] = 0
    table = lambda y: spark.createDataFrame([(0, r, t, float(obs[r, t]), float(y[r, t])) for r in range(3) for t in range(12)], "shot bigint, rcv bigint, it bigint, obs double, syn double")
    plain = {"l1": lambda r: np.abs(r).sum(), "l2": lambda r: np.sqrt((r * r).sum(axis=1)).sum(), "smooth_l1": lambda r: np.where(np.abs(r) < 1, r * r / 2, np.abs(r) - 0.5).sum(), "student_t": lambda r: np.log1p(r * r).sum()}[name]
    over = lambda x: x / np.where((top := np.abs(x).max(axis=1, keepdims=True)) > 0, top, 1.0)
    loss = (lambda y: plain(over(y)[:2] - over(obs)[:2])) if peaks else (lambda y: plain(y - obs))
    make = getattr(adjoint, name)
    for r in (adjoint.of_peaks(table(syn), make) if peaks else make(table(syn))).collect():
        up, down = syn.copy(), syn.copy()
        up[r.rcv, r.it] += 1e-6
        down[r.rcv, r.it] -= 1e-6
        if peaks and r.rcv == 2:
            assert r.adjoint == 0
        else:
            assert math.isclose((loss(up) - loss(down)) / 2e-6, r.adjoint, rel_tol=1e-4, abs_tol=1e-6), (name, r)


@pytest.mark.parametrize("method", ["sd", "cg", "lbfgs"])
def test_minimise(spark, method):
    """A badly scaled quadratic."""
    start = spark.range(6).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    weight = F.pow(F.lit(3.0), F.col("i"))

    def objective(point):
        made = point.select("i", (weight * (F.col("v") - F.col("i"))).alias("grad"), (weight * (F.col("v") - F.col("i")) * (F.col("v") - F.col("i")) / 2).alias("l"))
        return float(made.agg(F.sum("l")).first()[0]), made.select("i", "grad")

    _, losses = descent.minimise(objective, start, method, iterations=8)
    assert losses == sorted(losses, reverse=True) and losses[-1] < {"sd": 0.5, "cg": 0.2, "lbfgs": 0.05}[method] * losses[0]


def test_newton_direction(spark):
    weight = F.col("i") + 1.0
    table = spark.range(5).select(F.col("id").alias("i"), (F.col("id") + 2.0).alias("g"))
    made = descent.newton_direction(table, lambda t: t.select("i", (weight * F.col("d")).alias("hd")), inner=5, forcing=1e-6)
    for r in made.collect():
        assert math.isclose(r.d, -(r.i + 2.0) / (r.i + 1.0), rel_tol=1e-6)


def test_optimisers_descend(spark):
    for rule in optimise.RULES:
        state = spark.range(3).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
        for t in (1, 2, 3):
            state = optimise.step(state.withColumn("grad", 2 * F.col("v")), rule, 0.01, t)
        assert all(abs(r.v) < r.i + 1 for r in state.collect()), rule
    with pytest.raises(ValueError):
        optimise.step(state, "nothing", 0.1, 1)


def test_gathers_round_trip(spark, small, tmp_path):
    traces = views.trace_rows(views.table(spark, small, "embeddings")).withColumn("component", F.lit("p"))
    views.save_gathers(traces, f"{tmp_path}/g")
    assert views.load_gathers(spark, f"{tmp_path}/g", (2, 4)).count() == traces.where("shot IN (2, 3)").count()
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    rows = views.text_matrix(spark, f"{tmp_path}/m.txt").orderBy("iz", "ix").collect()
    assert [(r.iz, r.ix, r.v) for r in rows] == [(z, x, 3.0 * z + x + 1) for z in (0, 1) for x in (0, 1, 2)]


def test_edges(spark):
    dead = spark.createDataFrame([(0, 0, [0.0] * 4, [0.0] * 4), (0, 2, [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])], "shot bigint, rcv bigint, obs array<double>, syn array<double>")
    long = views.samples(dead, "obs", "syn")
    for name, f in misfit.SAMPLE_MISFITS.items():
        value = f(long).first()["misfit"]
        assert value is not None and not math.isnan(value) and (name == "global_correlation" or abs(value) < 1e-12)
    for f in (misfit.travel_time, misfit.envelope, misfit.soft_dtw, misfit.sinkhorn):
        assert abs(f(dead).first()["misfit"]) < 1e-9
    assert misfit.panel(long.limit(0)).count() == 0
    one = spark.createDataFrame([(0, 0, 5.0)], "iz bigint, ix bigint, v double")
    assert grid.total_variation(one).first().penalty == 0 and grid.smooth(one, 2).first().v == 5.0
    assert spark.range(1).select(rock.constrained(F.lit(float("nan")), 1.0, 2.0)).first()[0] == 2.0
    with pytest.raises(ValueError):
        rock.transverse("a", "b", "c", "d", "e", "tti")


def test_stream_of_shots(spark, small, tmp_path):
    pairs = views.samples(views.pair_rows(views.trace_rows(views.table(spark, small, "embeddings"))), "obs", "syn")
    pairs.repartition(3, "shot").write.parquet(f"{tmp_path}/in")
    stream = streaming.shot_stream(spark, f"{tmp_path}/in", pairs._jdf.schema().toDDL())
    streaming.accumulate(stream, misfit.l2, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r.shot: r.misfit for r in streaming.totals(spark, f"{tmp_path}/out").collect()}
    want = {r.shot: r.misfit for r in misfit.l2(pairs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
