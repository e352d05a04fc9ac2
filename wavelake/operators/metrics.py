"""Quality of models against the truth, by iteration; ensembles; loss curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelake.operators.grid import along, local, shifted, total


def compared(truth: DataFrame, models: DataFrame) -> DataFrame:
    """truth (iz, ix, v) and models (iter, iz, ix, v) -> iter, iz, ix, t, v."""
    return models.join(truth.select("iz", "ix", F.col("v").alias("t")), ["iz", "ix"])


def errors(both: DataFrame) -> DataFrame:
    """iter, mse, mape (over the signed truth), snr (dB), in one pass."""
    d = F.col("v") - F.col("t")
    t = F.nullif(F.col("t"), F.lit(0.0))
    return both.groupBy("iter").agg(F.avg(d * d).alias("mse"), (100 * F.avg(F.abs(d) / t)).alias("mape"), (10 * F.log10(F.sum(F.col("t") * F.col("t")) / F.nullif(F.sum(d * d), F.lit(0.0)))).alias("snr"))


def ssim(both: DataFrame) -> DataFrame:
    """iter, ssim: structural similarity in 3 x 3 windows with sample covariances; cells of the border are left out."""
    z, x = (along(axis, ("iter",)).rowsBetween(-1, 1) for axis in "zx")
    span = both.groupBy("iter").agg((F.greatest(F.max("t"), F.max("v")) - F.least(F.min("t"), F.min("v"))).alias("range"), F.max("iz").alias("z1"), F.max("ix").alias("x1"))
    products = {"t": F.col("t"), "v": F.col("v"), "tt": F.col("t") * F.col("t"), "vv": F.col("v") * F.col("v"), "tv": F.col("t") * F.col("v")}
    place = ("iter", "iz", "ix", "tz_", "tx_")

    def sums(tiles: DataFrame) -> DataFrame:
        down = tiles.select(*place, *(F.sum(c).over(z).alias(n) for n, c in products.items()))
        return down.select(*place, *((F.sum(n).over(x) / 9).alias(n) for n in products))

    box = local(both, 1, sums, ("iter",)).join(span, "iter")
    inner = box.where("iz > 0 AND ix > 0 AND iz < z1 AND ix < x1")
    t, v = F.col("t"), F.col("v")
    cov = lambda c, a, b: 9 / 8 * (F.col(c) - a * b)
    c1, c2 = (F.pow(k * F.col("range"), F.lit(2.0)) for k in (0.01, 0.03))
    value = (2 * t * v + c1) * (2 * cov("tv", t, v) + c2) / ((t * t + v * v + c1) * (cov("tt", t, t) + cov("vv", v, v) + c2))
    return inner.groupBy("iter").agg(F.avg(value).alias("ssim"))


def uncertainty(ensemble: DataFrame) -> DataFrame:
    """(draw, iz, ix, v) -> iz, ix, mean, spread: the mean absolute deviation over the draws, by two aggregations."""
    mean = ensemble.groupBy("iz", "ix").agg(F.avg("v").alias("mean"))
    return ensemble.join(mean, ["iz", "ix"]).groupBy("iz", "ix").agg(F.first("mean").alias("mean"), F.avg(F.abs(F.col("v") - F.col("mean"))).alias("spread"))


def scaled_curve(losses: DataFrame) -> DataFrame:
    """(run, iter, loss) -> loss between 0 and 1 in each run."""
    low, high = (f("loss").over(Window.partitionBy("run")) for f in (F.min, F.max))
    return losses.withColumn("loss", (F.col("loss") - low) / F.nullif(high - low, F.lit(0.0)))


def roughness(grid: DataFrame) -> DataFrame:
    """The mean size of the five-point Laplacian inside the grid."""
    five = total([shifted("v", k, a) for k in (-1, 1) for a in "xz"]) - 4 * F.col("v")
    return local(grid, 1, lambda t: t.select("iz", "ix", "tz_", "tx_", five.alias("l"))).agg(F.avg(F.abs("l")).alias("roughness"))
