"""Wavelets for a table of shots, boundary maps, layered models and anomalies for a table of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ricker(t: Column, f0: Column, t0: Column) -> Column:
    tau = (math.pi * f0) * (math.pi * f0)
    s = (t - t0) * (t - t0)
    return (1 - 2 * tau * s) * F.exp(-tau * s)


def wavelets(shots: DataFrame, nt: int, dt: float, kind: str = "ricker") -> DataFrame:
    """(shot, f0, t0, a; a null t0 is 1.2 / f0) -> shot, it, t, amp. gaussian: the Ricker wavelet summed twice, without dt."""
    if kind.lower() not in ("ricker", "gaussian", "ramp"):
        raise ValueError(f"unknown wavelet {kind}")
    t0 = F.coalesce(F.col("t0"), 1.2 / F.col("f0"))
    rows = shots.select("shot", "f0", "a", t0.alias("t0"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1)).cast("array<bigint>")).alias("it")).withColumn("t", F.col("it") * dt)
    if kind.lower() == "ramp":
        return rows.select("shot", "it", "t", (F.col("a") * 0.5 * (1 + F.tanh(F.col("t") / F.col("t0")))).alias("amp"))
    made = rows.select("shot", "it", "t", (F.col("a") * ricker(F.col("t"), F.col("f0"), F.col("t0"))).alias("amp"))
    if kind.lower() == "gaussian":
        up_to = Window.partitionBy("shot").orderBy("it").rowsBetween(Window.unboundedPreceding, 0)
        made = made.withColumn("amp", F.sum("amp").over(up_to)).withColumn("amp", F.sum("amp").over(up_to))
    return made


def shift_sweep(shifts: DataFrame, nt: int = 1000, dt: float = 0.003, f0: float = 6.0, t0: float = 0.5, roll: int = 330) -> DataFrame:
    """(shot, shift) -> shot, rcv, it, obs, syn: a rolled Ricker wavelet and itself moved by each shift."""
    at = lambda k: ricker(F.pmod(F.col("it") - k, F.lit(nt)) * dt, F.lit(f0), F.lit(t0))
    rows = shifts.select("shot", "shift", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("it"))
    return rows.select("shot", F.lit(0).cast("long").alias("rcv"), "it", at(F.lit(roll)).alias("obs"), at(roll + F.col("shift")).alias("syn"))


def outside(i: str, n: int, pml: int, first: bool = True) -> Column:
    """How many cells a place lies outside of the inner grid (0 inside); without `first`, only at the far end counts."""
    far = F.col(i) - (n + (pml if first else 0)) + 1
    return F.greatest(far, F.lit(0)) if not first else F.greatest(pml - F.col(i), far, F.lit(0))


def pml_damping(cells: DataFrame, nz: int, nx: int, dx: float, pml: int, vmax: float, free_surface: bool = True) -> DataFrame:
    """(iz, ix of the padded grid) -> iz, ix, damp: quadratic in the distance to the inner grid; corners take the deeper of
    the two sides."""
    a = (pml - 1) * dx
    kappa = -3 * vmax * math.log(1e-6) / (2 * a)
    depth = F.greatest(outside("ix", nx, pml), outside("iz", nz, pml, not free_surface))
    return cells.select("iz", "ix", (kappa * F.pow(F.greatest(depth - 1, F.lit(0)) * dx / a, F.lit(2.0))).alias("damp"))


def sine_taper(cells: DataFrame, nz: int, nx: int, pml: int, free_surface: bool = False) -> DataFrame:
    """(iz, ix of the padded grid) -> iz, ix, damp: squared sines towards each side, multiplied."""
    hz, wx = nz + (1 if free_surface else 2) * pml, nx + 2 * pml
    side = lambda i: F.when(i < pml, F.pow(F.sin(math.pi / 2 * i / pml), F.lit(2.0))).otherwise(1.0)
    top = F.lit(1.0) if free_surface else side(F.col("iz"))
    return cells.select("iz", "ix", (top * side(hz - 1 - F.col("iz")) * side(F.col("ix")) * side(wx - 1 - F.col("ix"))).alias("damp"))


def sponge(cells: DataFrame, nz: int, nx: int, pml: int, alpha: float = 0.0053, free_surface: bool = True) -> DataFrame:
    """(iz, ix of the padded grid) -> iz, ix, damp: exp(-(alpha * depth)^2), the deepest side of a corner."""
    depth = F.greatest(outside("ix", nx, pml) - 1, outside("iz", nz, pml, not free_surface) - 1, F.lit(0))
    return cells.select("iz", "ix", F.exp(-F.pow(alpha * depth, F.lit(2.0))).alias("damp"))


def split_pml(cells: DataFrame, nz: int, nx: int, dx: float, dz: float, pml: int, vmax: float, free_surface: bool = True) -> DataFrame:
    """(iz, ix of the padded grid) -> iz, ix, bcx, bcz."""
    scale = -math.log(1e-6) * 3 * vmax / (2 * pml**3)
    power = lambda d, h: d * d * scale / h
    return cells.select("iz", "ix", power(outside("ix", nx, pml), dx).alias("bcx"), power(outside("iz", nz, pml, not free_surface), dz).alias("bcz"))


#: vp, vs and rho at the surface, and what the whole depth adds to them (fixed values).
SURFACE = {"vp": (3.0, 1.5), "vs": (2.46, 4.48 - 3.46), "rho": (2.72, 3.32 - 2.72)}


def gap_of(step: float, anomaly: bool) -> float:
    """How far below its upper knot a step's lower one lies."""
    return step - (1.0 if anomaly else step / 5)


def profile(layers: DataFrame, depth: Column, step: float, anomaly: bool = False) -> DataFrame:
    """(k, the layer's number) -> y, vp, vs, rho: a staircase of two knots a layer, linear in depth."""
    y0 = F.col("k") * F.lit(step)
    knots = F.explode(F.array(y0, y0 + gap_of(step, anomaly)))
    return layers.select(knots.alias("y"), *((y0 / depth * rise + top).alias(c) for c, (top, rise) in SURFACE.items()))


def layered(places: DataFrame, y: Column, depth: float, step: float, anomaly: bool = False) -> DataFrame:
    """Places with vp, vs and rho of the profile at their depth y, between whose knots it is linear: constant in the upper
    part of a layer, then on the way to the next. A projection: no knots are joined."""
    gap = gap_of(step, anomaly)
    k = F.floor(y / step)
    rest = y - k * step
    level = k * step + F.when(rest <= gap, 0.0).otherwise(step * (rest - gap) / (step - gap))
    return places.select("*", *((level / depth * rise + top).alias(c) for c, (top, rise) in SURFACE.items()))


def with_ellipses(model: DataFrame, nz: int, nx: int, dz: float, dx: float, pml: int = 0) -> DataFrame:
    """Two ellipses hold the mean of what is inside them, a tenth up in the first and down in the second."""
    x1, y1 = (nx - 1) * dx, (nz - 1) * dz
    inside = lambda fx, fy: F.pow((F.col("ix") * dx - ((x1 - pml * dx) * fx + 0.5 * pml * dx)) / (x1 / 6), F.lit(2.0)) + F.pow((F.col("iz") * dz - ((y1 - pml * dz) * fy + 0.5 * pml * dz)) / (y1 / 10), F.lit(2.0)) < 1
    out = model
    for fx, fy, factor in ((2 / 3, 1 / 3, 1.1), (1 / 3, 2 / 3, 1 / 1.1)):
        held = out.withColumn("in_", inside(fx, fy))
        means = held.where("in_").agg(*(F.avg(c).alias(c + "_") for c in ("vp", "vs", "rho")), F.lit(True).alias("in_"))
        out = held.join(F.broadcast(means), "in_", "left").select("iz", "ix", *(F.when(F.col("in_"), F.col(c + "_") * factor).otherwise(F.col(c)).alias(c) for c in ("vp", "vs", "rho")))
    return out


def linear_start(model: DataFrame, nz: int, mask: int = 10) -> DataFrame:
    """vp below the first rows rises evenly from its least to its largest value there; the first rows stay."""
    ends = model.where(F.col("iz") >= mask).agg(F.min("vp").alias("lo"), F.max("vp").alias("hi"), F.lit(1).alias("k_"))
    line = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("iz") - mask) / (nz - 1 - mask)
    held = model.withColumn("k_", F.lit(1)).join(F.broadcast(ends), "k_")
    return held.withColumn("vp", F.when(F.col("iz") < mask, F.col("vp")).otherwise(line)).drop("k_", "lo", "hi")


def gauss2(grid: DataFrame, mean: tuple[float, float], sigma: tuple[float, float]) -> DataFrame:
    """A normalised two-dimensional Gaussian at (ix, iz)."""
    d = F.pow((F.col("ix") - mean[0]) / sigma[0], F.lit(2.0)) + F.pow((F.col("iz") - mean[1]) / sigma[1], F.lit(2.0))
    return grid.withColumn("v", F.exp(-d / 2) / (2 * math.pi * sigma[0] * sigma[1]))


def noisy(samples: DataFrame, std: float, bias: float = 0.1, v: str = "amp") -> DataFrame:
    """Gaussian noise of that deviation around each trace's mean times bias, drawn from (shot, rcv, it): the same on any cluster."""
    u = lambda salt: (F.pmod(F.xxhash64("shot", "rcv", "it", F.lit(salt)), F.lit(1 << 52)) + 1) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return samples.withColumn(v, F.col(v) + F.avg(v).over(Window.partitionBy("shot", "rcv")) * bias + std * normal)
