"""Window expressions along a trace: normalisations, differences, running sums, unwrapping, rolling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelake.operators.quantile import by_salted_key, exact_quantile
from wavelake.sources.store import settled

TRACE = ["shot", "rcv"]


def whole(keys: list[str] | None = None) -> Window:
    return Window.partitionBy(*(keys or TRACE))


def along(order: str = "it", keys: list[str] | None = None) -> Window:
    return Window.partitionBy(*(keys or TRACE)).orderBy(order)


def running(order: str = "it", keys: list[str] | None = None) -> Window:
    return along(order, keys).rowsBetween(Window.unboundedPreceding, 0)


def over_peak(v: str, eps: float = 0.0) -> Column:
    """v over its trace's largest size; 0 for a dead trace."""
    peak = F.max(F.abs(v)).over(whole())
    return F.col(v) / (peak + eps) if eps else F.coalesce(F.col(v) / F.nullif(peak, F.lit(0.0)), F.lit(0.0))


def over_sum(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v / (F.sum(v).over(whole()) + 1e-18)


def over_norm(v: str) -> Column:
    """v over its trace's 2-norm; null for a dead trace."""
    return F.col(v) / F.nullif(F.sqrt(F.sum(F.col(v) * F.col(v)).over(whole())), F.lit(0.0))


def running_sum(v: Column | str) -> Column:
    return F.sum(v).over(running())


def difference(v: str) -> Column:
    return F.col(v) - F.lag(v).over(along())


def centred_difference(v: str) -> Column:
    """Half the gap of the neighbours; 0 at the ends."""
    return F.coalesce((F.lead(v).over(along()) - F.lag(v).over(along())) / 2, F.lit(0.0))


def with_unwrapped(samples: DataFrame, phase: str, out: str = "unwrapped") -> DataFrame:
    """Steps of a phase beyond pi are brought within (-pi, pi], and what that takes is carried on along the trace."""
    pi = F.lit(3.141592653589793)
    step = samples.withColumn("d_", F.coalesce(F.col(phase) - F.lag(phase).over(along()), F.lit(0.0)))
    d = F.col("d_")
    # the remainder by floor, as pmod() of a double
    wrapped = d + pi - F.floor((d + pi) / (2 * pi)) * 2 * pi - pi
    wrapped = F.when((wrapped == -pi) & (d > 0), pi).otherwise(wrapped)
    fixed = step.withColumn("fix_", F.when(F.abs(d) < pi, 0.0).otherwise(wrapped - d))
    return fixed.withColumn(out, F.col(phase) + F.sum("fix_").over(running())).drop("d_", "fix_")


def rolled(samples: DataFrame, shift: int, length: int) -> DataFrame:
    """Samples moved later by shift, around the trace's end."""
    return samples.withColumn("it", F.pmod(F.col("it") + shift, F.lit(length)))


def zero_crossings(samples: DataFrame, v: str = "amp") -> DataFrame:
    """The samples as (shot, rcv, t double, v) and, between samples of other sign, the point where the line through them is 0."""
    w = along()
    nxt = samples.select("shot", "rcv", F.col("it").cast("double").alias("t"), F.col(v).alias("v"), F.lead(v).over(w).alias("n"), F.lead("it").over(w).alias("u"))
    slope = (F.col("n") - F.col("v")) / (F.col("u") - F.col("t"))
    cross = nxt.where("(v < 0) <> (n < 0)").select("shot", "rcv", (F.col("t") - F.col("v") / slope).alias("t"), F.lit(0.0).alias("v"))
    return nxt.select("shot", "rcv", "t", "v").unionByName(cross)


def std_scaled(samples: DataFrame, v: str = "amp", spacing: float = 1.0, factor: float = 1.0) -> DataFrame:
    """All values over the largest population deviation of any trace of the shot, times spacing and factor."""
    by_trace = samples.groupBy("shot", "rcv").agg(F.stddev_pop(v).alias("s_")).groupBy("shot").agg(F.max("s_").alias("s_"))
    return samples.join(by_trace, "shot").withColumn(v, F.col(v) / F.nullif(F.col("s_"), F.lit(0.0)) * spacing * factor).drop("s_")


def clipped(samples: DataFrame, v: str = "amp", share: float = 0.999) -> DataFrame:
    """Values cut to the exact quantile of their size, by shot; no task holds a shot's values."""
    limit = exact_quantile(samples, ["shot"], F.abs(v), share, "most", settled)
    return by_salted_key(samples, limit, ["shot"]).withColumn(v, F.greatest(F.least(F.col(v), F.col("most")), -F.col("most")))
