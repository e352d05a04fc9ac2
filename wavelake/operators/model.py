"""Whole earth models: refreshed parameters, resampling, cropping, gradients of them, and their tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions import rock

Bounds = dict[str, tuple[float | None, float | None]]
META = "par string, low double, high double, requires_grad boolean"


def refreshed(cells: DataFrame, bounds: Bounds, vp_from_vs: bool = False, rho_from_vp: bool = True, axis: str | None = None) -> DataFrame:
    """(vp, vs, rho, and eps, delta, gamma if there is an axis, 'vti' or 'hti') -> these, renewed, with Lame parameters and moduli.

    Density comes from vp as it is given, then vp from vs, then each parameter is held within its bounds. All of it is
    one projection. Without an axis the medium is isotropic."""
    thomsen = ("eps", "delta", "gamma") if axis else ()
    out = cells.withColumn("rho", rock.gardner("vp")) if rho_from_vp else cells
    out = out.withColumn("vp", rock.vp_from_vs("vs")) if vp_from_vs else out
    out = out.withColumns({c: rock.constrained(c, *bounds.get(c, (None, None))) for c in ("vp", "vs", "rho", *thomsen)})
    moduli = rock.thomsen_to_moduli("vp", "vs", "rho", *(thomsen or (F.lit(0.0),) * 3))
    plane = rock.transverse(*moduli.values(), axis or "vti")
    return out.withColumns(rock.lame("vp", "vs", "rho") | plane)


def resampled(cells: DataFrame, columns: list[str], step: tuple[float, float], n: tuple[int, int], start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Bilinear values at iz = start + k * step (in old cells), k < n, and the same along ix: (iz, ix, columns) numbered by k.

    Each old cell sends its share to the new points next to it and shares are added up: one shuffle with partial sums,
    no join and no line in one task. A point that lacks a corner (outside, absent or null in a column) has no row."""
    held = cells.select("iz", "ix", *columns).dropna(subset=columns)
    for axis, s, m, o in zip(("iz", "ix"), step, n, start, strict=True):
        first, last = F.ceil((F.col(axis) - 1 - o) / s), F.floor((F.col(axis) + 1 - o) / s)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(m - 1))
        held = held.withColumn(f"{axis}_", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn(f"{axis}w", 1 - F.abs(o + F.col(f"{axis}_") * s - F.col(axis))).where(f"{axis}w > 0")
    w = F.col("izw") * F.col("ixw")
    made = held.groupBy(F.col("iz_").alias("iz"), F.col("ix_").alias("ix")).agg(F.sum(w).alias("w_"), *(F.sum(w * F.col(c)).alias(c) for c in columns))
    return made.where(F.col("w_") > 1 - 1e-9).drop("w_")


def cropped(cells: DataFrame, z: tuple[int, int], x: tuple[int, int], stride: int = 1) -> DataFrame:
    """Every stride-th cell of [z) by [x), numbered anew; the ranges reach the scan."""
    held = cells.where((F.col("iz") >= z[0]) & (F.col("iz") < z[1]) & (F.col("ix") >= x[0]) & (F.col("ix") < x[1]))
    held = held.where(((F.col("iz") - z[0]) % stride == 0) & ((F.col("ix") - x[0]) % stride == 0))
    return held.withColumns({c: F.floor((F.col(c) - o) / stride).cast("long") for c, o in (("iz", z[0]), ("ix", x[0]))})


def gradient_or_zero(cells: DataFrame, gradient: DataFrame) -> DataFrame:
    """iz, ix, grad: the gradient's at each of the model's cells, 0 where it has none."""
    own = gradient.select("iz", "ix", "grad")
    return cells.select("iz", "ix").join(own, ["iz", "ix"], "left").select("iz", "ix", F.coalesce("grad", F.lit(0.0)).alias("grad"))


def save_model(cells: DataFrame, path: str, bounds: Bounds, requires_grad: dict[str, bool] | None = None) -> None:
    """The cells, and a row of bounds and flag for each parameter, under path; nothing there is overwritten."""
    pars = [c for c in cells.columns if c not in ("iz", "ix")]
    rows = [(p, *bounds.get(p, (None, None)), bool((requires_grad or {}).get(p, False))) for p in pars]
    cells.write.mode("errorifexists").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame(rows, META).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, Bounds, dict[str, bool]]:
    """Cells, bounds and flags (a row for each parameter) of save_model()."""
    meta = spark.read.schema(META).parquet(f"{path}/meta").collect()
    return spark.read.parquet(f"{path}/cells"), {r.par: (r.low, r.high) for r in meta}, {r.par: r.requires_grad for r in meta}
