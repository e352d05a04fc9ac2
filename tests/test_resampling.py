"""Splines against a dense solution, short-time spectra against plain sums, quantiles against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import timefreq
from wavelake.operators import quantile, spline


def plain_spline(y, x):
    """A cubic for each interval, by one dense system: values, first two derivatives, third ones at the second and last but one point."""
    n = len(y) - 1
    rows, right = [], []

    def row(k, t, derivative):
        out = np.zeros(4 * n)
        for p in range(derivative, 4):
            out[4 * k + p] = math.perm(p, derivative) * t ** (p - derivative)
        return out

    for k in range(n):
        rows += [row(k, 0.0, 0), row(k, 1.0, 0)]
        right += [y[k], y[k + 1]]
    for k in range(n - 1):
        for d in (1, 2):
            rows.append(row(k, 1.0, d) - row(k + 1, 0.0, d))
            right.append(0.0)
    for k in (0, n - 2):
        rows.append(row(k, 1.0, 3) - row(k + 1, 0.0, 3))
        right.append(0.0)
    c = np.linalg.solve(np.array(rows), np.array(right))
    at = np.minimum(np.floor(x).astype(int), n - 1)
    return np.array([sum(c[4 * k + p] * t**p for p in range(4)) for k, t in zip(at, x - at, strict=True)])


def test_spline_of_a_line():
    rng = np.random.default_rng(1)
    for n in (4, 5, 6, 9, 60):
        y, x = rng.normal(size=n), np.linspace(0, n - 1, 37)
        assert np.allclose(spline.evaluated(y[None], x)[0], plain_spline(y, x), atol=1e-9)
    cubic = lambda t: t**3 - 4 * t * t + 1
    assert np.allclose(spline.evaluated(cubic(np.arange(6.0))[None], np.array([0.5, 4.7, 5.0]))[0], cubic(np.array([0.5, 4.7, 5.0])))
    assert np.allclose(spline.evaluated(np.array([[0.0, 1.0, 4.0]]), np.array([1.5]))[0], 2.25)
    assert np.allclose(spline.evaluated(np.array([[3.0]]), np.array([0.0]))[0], 3) and np.allclose(spline.evaluated(np.array([[3.0, 5.0]]), np.array([0.5]))[0], 4)


def grid_of(spark, v):
    return spark.createDataFrame([(i, j, float(x)) for i, line in enumerate(v) for j, x in enumerate(line)], "iz bigint, ix bigint, v double")


def test_spline_tiles(spark, monkeypatch):
    """Lines of many tiles and blocks are as one solved whole."""
    for name, value in (("TILE", 48), ("LINES", 3)):
        monkeypatch.setattr(spline, name, value)
    v = np.random.default_rng(2).normal(size=(7, 203)) * 1000
    got = {(r.iz, r.ix): r.v for r in spline.spline_resampled(grid_of(spark, v), ["v"], (0.6, 1.37), (100, 1000), (0.1, 0.25)).collect()}
    zs, xs = np.arange(0.1, 6 + 1e-9, 0.6), np.arange(0.25, 202 + 1e-9, 1.37)
    tall = np.array([plain_spline(v[:, j], zs) for j in range(203)]).T
    want = np.array([plain_spline(line, xs) for line in tall])
    assert len(got) == want.size
    assert max(abs(got[i, j] - want[i, j]) for i in range(len(zs)) for j in range(len(xs))) < 1e-9 * 1000


def test_spline_holes(spark):
    cells = grid_of(spark, np.arange(24.0).reshape(2, 12)).withColumn("v", F.when(~((F.col("iz") == 1) & (F.col("ix") == 5)), F.col("v")))
    got = {(r.iz, r.ix): r.v for r in spline.spline_resampled(cells, ["v"], (1.0, 0.5), (2, 99)).collect()}
    assert {j for i, j in got if i == 0} == set(range(23)) and {j for i, j in got if i == 1} == set(range(9)) | set(range(12, 23))
    assert all(math.isclose(v, 12 * i + j / 2) for (i, j), v in got.items())
    assert spline.spline_resampled(cells.limit(0), ["v"], (1.0, 0.5), (2, 9)).count() == 0
    with pytest.raises(ValueError):
        spline.spline_resampled(cells, ["v"], (0.0, 1.0), (2, 2))


def test_spectra_and_back(spark):
    rng = np.random.default_rng(4)
    traces = {1: rng.normal(size=50), 2: rng.normal(size=50), 3: rng.normal(size=7)}
    table = spark.createDataFrame([(i, x.tolist()) for i, x in traces.items()] + [(4, []), (5, None)], "rcv bigint, amp array<double>")
    rows = timefreq.spectra(table, 12).collect()
    w = timefreq.window(12)
    assert len(rows) == 2 * timefreq.frames_of(50, 12) + timefreq.frames_of(7, 12)
    for r in rows:
        padded = np.concatenate([np.zeros(6), traces[r.rcv], np.zeros(24)])
        own = padded[r.frame * 6 : r.frame * 6 + 12] * w / w.sum()
        want = [(own * np.exp(-2j * math.pi * k * np.arange(12) / 12)).sum() for k in range(7)]
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), want)
    lengths = table.select("rcv", F.size("amp").alias("n"))
    back = timefreq.restored(timefreq.spectra(table, 12).join(lengths, "rcv"), 12, "n", ["rcv"]).collect()
    assert {r.rcv for r in back} == {1, 2, 3} and all(np.allclose(r.amp, traces[r.rcv]) for r in back)
    with pytest.raises(ValueError):
        timefreq.window(7)


def test_phase_correlation(spark):
    rng = np.random.default_rng(6)
    obs, syn = rng.normal(size=(3, 40)), rng.normal(size=(3, 40))
    table = spark.createDataFrame([(i // 2, o.tolist(), s.tolist()) for i, (o, s) in enumerate(zip(obs, syn, strict=True))] + [(7, [1.0], [1.0, 2.0]), (7, None, None)], "shot bigint, obs array<double>, syn array<double>")
    spectrum = lambda x: np.fft.rfft(timefreq.framed(x[None], 8), axis=2)[0] / timefreq.window(8).sum()
    want = [-sum(np.abs(d) * np.abs(u) * np.cos(np.angle(d) - np.angle(u)) for d, u in [(spectrum(o), spectrum(s))]).sum() for o, s in zip(obs, syn, strict=True)]
    got = {r.shot: r.misfit for r in timefreq.phase_correlation(table, 8).collect()}
    assert math.isclose(got[0], want[0] + want[1]) and math.isclose(got[1], want[2]) and got[7] == 0


@pytest.mark.parametrize(("accuracy", "most"), [(1000, 1 << 20), (20, 50)])
def test_quantiles(spark, monkeypatch, accuracy, most):
    """Small and large keys, ties, one value alone; with a coarse sketch that is narrowed several times."""
    monkeypatch.setattr(quantile, "ACCURACY", accuracy)
    monkeypatch.setattr(quantile, "MOST", most)
    rng = np.random.default_rng(7)
    values = {1: rng.normal(size=5000) ** 9, 2: np.repeat([0.0, 1.0, 5.0], [3000, 1, 2000]), 3: np.array([4.0]), 4: np.full(2000, 2.5), 5: np.array([1.0, 3.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [(1, None), (6, None), (3, float("nan"))], "shot bigint, v double")
    for share in (0.0, 0.5, 0.613, 0.999, 1.0):
        got = {r.shot: r.q for r in quantile.exact_quantile(rows, ["shot"], F.col("v"), share, "q", lambda df: df.cache()).collect()}
        assert got.keys() == values.keys()
        for k, v in values.items():
            assert math.isclose(got[k], np.quantile(v, share), rel_tol=1e-12, abs_tol=1e-12), (k, share)


def test_quantile_of_ten_million(spark):
    """One shot holds all rows; its state stays small (what is counted out is a small share of the rows)."""
    rows = spark.range(10_000_000).select(F.lit(1).alias("shot"), ((F.col("id") * 7919) % 10_000_000).cast("double").alias("v"))
    assert quantile.exact_quantile(rows, ["shot"], F.col("v"), 0.9, "q").first().q == pytest.approx(0.9 * 9_999_999)
    bounds = quantile.counted(rows, quantile.narrowed(rows, None, ["shot"], 0.9, 4 / quantile.ACCURACY), ["shot"], 0.9).first()
    assert bounds.under <= 0.9 * 9_999_999 < bounds.under + bounds.inside < bounds.under + 200_000
