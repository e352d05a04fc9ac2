"""Operators over grids (iz, ix, v): stencils, smoothing, padding, penalties, staggered means, gradient conditioning.

A grid is cut into tiles with halos, so no row, column or grid meets in one task; scalars come from one-row aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of a line's tile without its halo, in smoothing; cells of a tile's side, for operators on neighbours.
TILE, SIDE = 1024, 256


def tiled(grid: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each cell once for each tile (tz_, tx_) that it is in or within `reach` of, dealt by tile: the windows below need no
    more shuffle, along x or z. keys tell grids apart."""
    side = max(SIDE, reach)
    near = lambda axis: F.explode(F.array_distinct(F.array(*(F.floor((F.col(axis) + k) / side) for k in (-reach, 0, reach)))))
    return grid.withColumn("tz_", near("iz")).withColumn("tx_", near("ix")).repartition(*keys, "tz_", "tx_")


def local(grid: DataFrame, reach: int, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """build, over the grid's tiles with halos of `reach` cells; build keeps iz, ix, tz_ and tx_, and each cell comes back
    from its own tile."""
    side = max(SIDE, reach)
    own = (F.floor(F.col("iz") / side) == F.col("tz_")) & (F.floor(F.col("ix") / side) == F.col("tx_"))
    return build(tiled(grid, reach, keys)).where(own).drop("tz_", "tx_")


def along(axis: str, keys: tuple[str, ...] = ()) -> Window:
    """A tile's line in the direction of the axis."""
    other = "iz" if axis == "x" else "ix"
    return Window.partitionBy(*keys, "tz_", "tx_", other).orderBy("ix" if axis == "x" else "iz")


def shifted(v: str, k: int, axis: str) -> Column:
    """The value k cells further, of a tiled grid; null beyond the edge."""
    return F.col(v) if k == 0 else F.lead(v, k).over(along(axis)) if k > 0 else F.lag(v, -k).over(along(axis))


def total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def fd_coefficients(pairs: int, staggered: bool = True) -> list[float]:
    """First-derivative weights of so many pairs of points, exact for polynomials up to degree 2 * pairs."""
    at = np.array([k - 0.5 if staggered else k for k in range(1, pairs + 1)])
    odd = np.arange(1, 2 * pairs, 2)
    return (np.linalg.solve(at[None] ** odd[:, None], np.eye(pairs)[0]) / 2).tolist()


def staggered_difference(v: str, axis: str, forward: bool, order: int) -> Column:
    """Half a cell ahead (forward) or behind, of order 4, 6, 8 or 10, of a grid in tiles with halos of half the order; null
    where it would leave the grid."""
    ahead = 1 if forward else 0
    weights = fd_coefficients(order // 2)
    return total([c * (shifted(v, k - 1 + ahead, axis) - shifted(v, ahead - k, axis)) for k, c in enumerate(weights, 1)])


def first_difference(v: str, axis: str) -> Column:
    """A cell less the next; 0 in the last."""
    return F.coalesce(F.col(v) - shifted(v, 1, axis), F.lit(0.0))


def second_difference(v: str, axis: str) -> Column:
    """0 at both edges."""
    return F.coalesce(shifted(v, -1, axis) - 2 * F.col(v) + shifted(v, 1, axis), F.lit(0.0))


# ---------------------------------------------------------------- penalties


def differences(grid: DataFrame, order: int, dx: float, dz: float) -> DataFrame:
    make = first_difference if order == 1 else second_difference
    return local(grid, 1, lambda t: t.select("iz", "ix", "tz_", "tx_", (make("v", "x") / dx).alias("x"), (make("v", "z") / dz).alias("z")))


def tikhonov(grid: DataFrame, order: int = 1, alpha_x: float = 1.0, alpha_z: float = 1.0, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    """The root of the weighted squared differences (of second order: over the spacing, not its square)."""
    d = differences(grid, order, dx, dz)
    return d.agg(F.sqrt(F.sum(alpha_x * F.col("x") * F.col("x") + alpha_z * F.col("z") * F.col("z"))).alias("penalty"))


def total_variation(grid: DataFrame, order: int = 1, alpha_x: float = 1.0, alpha_z: float = 1.0, dx: float = 1.0, dz: float = 1.0) -> DataFrame:
    d = differences(grid, order, dx, dz)
    return d.agg(F.sum(alpha_x * F.abs("x") + alpha_z * F.abs("z")).alias("penalty"))


# ---------------------------------------------------------------- smoothing


def blur_weights(span: int) -> list[float]:
    """A Gaussian of deviation span at -2 span, ..., 2 span in steps of 2."""
    return [math.exp(-0.5 * (2 * k / span) ** 2) for k in range(-span, span + 1)]


def smooth(grid: DataFrame, span: int = 10, v: str = "v") -> DataFrame:
    """Gaussian smoothing along z, then x; near an edge, or a null, the weights of what is there count.

    A line is cut into tiles of TILE cells with a halo of span cells, so that a task holds a tile and not a line; a tile is
    one convolution.
    """
    for axis, other in (("iz", "ix"), ("ix", "iz")):
        size = max(TILE, span)
        tile = lambda x: F.floor(x / size)
        wide = grid.withColumn(v, F.col(v).cast("double"))
        dealt = wide.withColumn("tile_", F.explode(F.array_distinct(F.array(tile(F.col(axis) - span), tile(F.col(axis)), tile(F.col(axis) + span)))))
        grid = dealt.groupBy(other, "tile_").applyInArrow(blur(axis, v, span, size), wide.schema)
    return grid


def blur(axis: str, v: str, span: int, size: int) -> Callable[[pa.Table], pa.Table]:
    """What smooths a tile of size cells with its halo, and gives back its own cells."""
    weights = np.array(blur_weights(span))

    def run(table: pa.Table) -> pa.Table:
        at, value = table.column(axis).to_numpy(), table.column(v).to_numpy(zero_copy_only=False).astype(float)
        place, there = at - at.min(), ~np.isnan(value)
        line, has = np.bincount(place, np.where(there, value, 0.0)), np.bincount(place, there.astype(float))
        top, bottom = (np.convolve(x, weights)[span : span + len(x)][place] for x in (line, has))
        made = pa.array(top / np.where(bottom > 0, bottom, 1.0), mask=bottom <= 0)
        own = pa.array(at // size == table.column("tile_").to_numpy())
        return table.set_column(table.column_names.index(v), v, made).filter(own).drop_columns("tile_")

    return run


def gaussian_filter(grid: DataFrame, sigma: float, nz: int, nx: int, v: str = "v") -> DataFrame:
    """Gaussian smoothing with the grid mirrored beyond its edges, to four deviations."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    w = [x / sum(raw) for x in raw]
    offsets = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in zip(range(-radius, radius + 1), w, strict=True)))
    for axis, other, n in (("iz", "ix", nz), ("ix", "iz", nx)):
        # a cell gives to each cell that it is an image for: i with image(i + k) = its place
        spread = grid.select(other, axis, v, F.explode(offsets).alias("o"))
        images = F.array(F.col(axis) - F.col("o.k"), -F.col(axis) - 1 - F.col("o.k"), 2 * F.lit(n) - 1 - F.col(axis) - F.col("o.k"))
        given = spread.select(other, F.explode(images).alias(axis), (F.col(v) * F.col("o.c")).alias(v)).where((F.col(axis) >= 0) & (F.col(axis) < n))
        grid = given.groupBy("iz", "ix").agg(F.sum(v).alias(v))
    return grid


def padded(grid: DataFrame, n: int, nz: int, nx: int, free_surface: bool = False) -> DataFrame:
    """The grid with n more cells on each side (not on top of a free surface), which repeat the edge."""
    top = 0 if free_surface else n

    def places(i: str, before: int, size: int) -> Column:
        own = F.col(i)
        return F.when(own == 0, F.sequence(F.lit(0), F.lit(before))).when(own == size - 1, F.sequence(own + before, own + before + n)).otherwise(F.array(own + before))

    tall = grid.withColumn("iz", F.explode(places("iz", top, nz).cast("array<bigint>")))
    return tall.withColumn("ix", F.explode(places("ix", n, nx).cast("array<bigint>")))


def staggered_means(grid: DataFrame, b: str = "b", mu: str = "mu") -> DataFrame:
    """bx, bz: the mean with the next cell along x and z; mu_xz: the mean of the cell and those beside, below and across (the cell twice)."""

    def build(tiles: DataFrame) -> DataFrame:
        held = tiles.withColumn("down_", shifted(mu, 1, "z"))
        mean = lambda axis: (F.col(b) + shifted(b, 1, axis)) / 2
        four = 0.2 * (2 * F.col(mu) + shifted(mu, 1, "x") + F.col("down_") + shifted("down_", 1, "x"))
        return held.select("*", mean("x").alias("bx"), mean("z").alias("bz"), four.alias("mu_xz")).drop("down_")

    return local(grid, 1, build)


# ---------------------------------------------------------------- gradient conditioning


def with_scalar(grid: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds an aggregate of the whole grid (one row, broadcast)."""
    one = grid.agg(value.alias(name), F.lit(1).alias("k_"))
    return grid.withColumn("k_", F.lit(1)).join(F.broadcast(one), "k_").drop("k_")


def tapered(grid: DataFrame, size: int, kind: str = "marine", floor: float = 0.001, v: str = "grad") -> DataFrame:
    """marine: the first rows become 0. land: a half Hamming window at the left edge, smoothed, turned over and squared."""
    if kind.lower() in ("marine", "offshore"):
        return grid.withColumn(v, F.when(F.col("iz") < size, 0.0).otherwise(F.col(v)))
    if kind.lower() not in ("land", "onshore"):
        raise ValueError(f"neither marine nor land: {kind}")
    turn = 2 * math.pi / (2 * size - 1)
    window = F.when(F.col("ix") < size, 0.54 - 0.46 * F.cos((F.col("ix") + size) * turn)).otherwise(0.0)
    made = with_scalar(smooth(grid.withColumn("t_", window), size // 2, "t_"), F.max("t_"), "top_")
    return made.withColumn(v, F.col(v) * F.pow(1 - (1 - floor) * F.col("t_") / F.col("top_"), F.lit(2.0))).drop("t_", "top_")


def illuminated(grid: DataFrame, span: int, v: str = "grad", energy: str = "forw") -> DataFrame:
    """The gradient over the square of the smoothed forward energy, relative to its maximum and 1e-4 at least."""
    made = with_scalar(smooth(grid, span, energy), F.max(F.col(energy) + 1e-5), "top_")
    return made.withColumn(v, F.col(v) / F.pow(F.greatest(F.col(energy) / F.col("top_"), F.lit(1e-4)), F.lit(2.0))).drop("top_")


def conditioned(grid: DataFrame, vmax: float, nz: int, nx: int, mute: int = 0, smoothing: int = 0, mask: str | None = None, illumination: bool = True, normal: bool = True, kind: str = "marine") -> DataFrame:
    """(iz, ix, grad, forw, perhaps a mask) -> grad after taper, mask, illumination, smoothing and scaling to vmax."""
    if mute:
        grid = tapered(grid, mute, kind, 0.0 if kind.lower() in ("marine", "offshore") else 0.001)
    if mask:
        grid = grid.withColumn("grad", F.col("grad") * F.col(mask))
    if illumination:
        grid = illuminated(grid, 40 if min(nz, nx) > 40 else min(nz, nx) // 2)
    if smoothing:
        if kind.lower() in ("marine", "offshore"):  # the water layer keeps apart
            below = smooth(grid.where(F.col("iz") >= mute), smoothing, "grad")
            grid = grid.where(F.col("iz") < mute).unionByName(below)
        else:
            grid = smooth(grid, smoothing, "grad")
    if normal:
        grid = with_scalar(grid, F.max(F.abs("grad")), "top_").withColumn("grad", vmax * F.col("grad") / F.nullif(F.col("top_"), F.lit(0.0))).drop("top_")
    return grid


def illumination(waves: DataFrame) -> DataFrame:
    """(shot, it, iz, ix, p) -> iz, ix, energy: squared pressure summed over time and shots, partly within tasks."""
    return waves.groupBy("iz", "ix").agg(F.sum(F.col("p") * F.col("p")).alias("energy"))


# ---------------------------------------------------------------- checks and summaries


def problems(grid: DataFrame, low: float, high: float) -> DataFrame:
    """How many cells are NaN, infinite, negative or out of bounds."""
    v = F.col("v")
    return grid.agg(F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.count_if(v < 0).alias("negative"), F.count_if(~v.between(low, high)).alias("outside"))


def complete(grid: DataFrame, nz: int, nx: int) -> DataFrame:
    """Whether every cell is there once."""
    own = grid.agg(F.count("*").alias("n"), F.min("iz").alias("z0"), F.max("iz").alias("z1"), F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.count_distinct("iz", "ix").alias("d"))
    ok = (F.col("n") == nz * nx) & (F.col("d") == nz * nx) & (F.col("z0") == 0) & (F.col("x0") == 0) & (F.col("z1") == nz - 1) & (F.col("x1") == nx - 1)
    return own.select(F.coalesce(ok, F.lit(False)).alias("complete"))


def summary(grid: DataFrame) -> DataFrame:
    return grid.agg(F.count("*").alias("cells"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"))
