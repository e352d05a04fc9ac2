"""Cubic-spline resampling of grids: the tensor product of splines that have no knot next to their ends.

A line is cut into tiles of TILE cells with a halo of HALO cells on both sides: what a cell adds to a spline falls to a
quarter with each cell, so beyond the halo nothing of it is left in a double. A tile holds LINES lines, whose systems are
solved at once. No task holds a line, and each axis costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a tile along its lines, cells of its halos, lines of a tile.
TILE, HALO, LINES = 1024, 40, 64


def curvatures(y: np.ndarray) -> np.ndarray:
    """Second derivatives at the points of each row: those of the spline without a knot at the second and last but one
    point; of a parabola through three points, 0 for fewer."""
    n = y.shape[1]
    m = np.zeros_like(y)
    if n < 3:
        return m
    d = y[:, :-2] - 2 * y[:, 1:-1] + y[:, 2:]  # d[:, k] belongs to point k + 1
    if n == 3:
        return np.repeat(d, 3, axis=1)
    m[:, 1], m[:, -2] = d[:, 0], d[:, -1]
    # m[k - 1] + 4 m[k] + m[k + 1] = 6 d between these two: down the rows, then up
    share, right = np.zeros(n), np.zeros_like(y)
    right[:, 1] = m[:, 1]
    for k in range(2, n - 2):
        share[k] = 1 / (4 - share[k - 1])
        right[:, k] = (6 * d[:, k - 1] - right[:, k - 1]) * share[k]
    for k in range(n - 3, 1, -1):
        m[:, k] = right[:, k] - share[k] * m[:, k + 1]
    m[:, 0], m[:, -1] = 2 * m[:, 1] - m[:, 2], 2 * m[:, -2] - m[:, -3]
    return m


def evaluated(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rows' splines at x, in points from 0."""
    if y.shape[1] == 1:
        return np.repeat(y, len(x), axis=1)
    m = curvatures(y)
    at = np.minimum(np.floor(x).astype(int), y.shape[1] - 2)
    t = x - at
    u = 1 - t
    return u * y[:, at] + t * y[:, at + 1] + ((u**3 - u) * m[:, at] + (t**3 - t) * m[:, at + 1]) / 6


def runs_of(there: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring places that are there."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], there.astype(int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def along_tiles(axis: str, other: str, columns: list[str], step: float, n: int, start: float, size: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        at, line, tile = table.column(axis).to_numpy(), table.column(other).to_numpy(), table.column("tile_")[0].as_py()
        first, (names, row) = int(at.min()), np.unique(line, return_inverse=True)
        shape = (len(names), int(at.max()) - first + 1)
        grids = []
        for c in columns:
            grid = np.full(shape, np.nan)
            grid[row, at - first] = table.column(c).to_numpy(zero_copy_only=False)
            grids.append(grid)
        there = ~np.isnan(sum(grids))
        own = np.arange(max(0, int(np.floor((tile * size - start) / step)) - 1), min(n, int(np.ceil(((tile + 1) * size - start) / step)) + 2))
        x = start + own * step
        keep = np.floor(x / size) == tile
        own, x = own[keep], x[keep] - first
        made: dict[str, list] = {axis: [], other: [], **{c: [] for c in columns}}
        patterns = {p.tobytes(): p for p in there}
        for key, pattern in patterns.items():  # lines with the same holes, mostly none, go together
            which = np.array([k for k in range(len(names)) if there[k].tobytes() == key])
            for a, b in runs_of(pattern):
                inside = (x >= a) & (x <= b - 1)
                if not inside.any():
                    continue
                made[axis].append(np.tile(own[inside], len(which)))
                made[other].append(np.repeat(names[which], inside.sum()))
                for c, grid in zip(columns, grids, strict=True):
                    made[c].append(evaluated(grid[which, a:b], x[inside] - a).ravel())
        kinds = {axis: np.int64, other: np.int64}
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0), pa.int64() if c in kinds else pa.float64()) for c, v in made.items()})

    return run


def spline_resampled(cells: DataFrame, columns: list[str], step: tuple[float, float], n: tuple[int, int], start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Values of the columns' cubic splines at iz = start + k * step (in old cells), k < n, and the same along ix: (iz, ix,
    columns) numbered by k. Points outside the grid have no row. Null, NaN or absent cells are holes: each stretch of
    a line between them is a spline of its own, and points in them have no row. Cells must be there once."""
    if min(step) <= 0:
        raise ValueError(f"steps must be above 0: {step}")
    kinds = ", ".join(f"{c} double" for c in columns)
    held = cells.select(F.col("iz").cast("long"), F.col("ix").cast("long"), *(F.col(c).cast("double") for c in columns)).dropna(subset=columns)
    for axis, other, s, m, o in zip(("iz", "ix"), ("ix", "iz"), step, n, start, strict=True):
        size = max(TILE, HALO)
        tile = lambda x: F.floor(x / size)
        dealt = held.withColumn("tile_", F.explode(F.array_distinct(F.array(tile(F.col(axis) - HALO), tile(F.col(axis)), tile(F.col(axis) + HALO)))))
        dealt = dealt.withColumn("block_", F.floor(F.col(other) / LINES))
        held = dealt.groupBy("tile_", "block_").applyInArrow(along_tiles(axis, other, columns, s, m, o, size), f"{axis} long, {other} long, {kinds}")
    return held.select("iz", "ix", *columns)
