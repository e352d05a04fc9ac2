"""Adjoint sources: derivatives of misfits by each sample of the synthetics.

Samples (shot, rcv, it, obs, syn) -> these and `adjoint`. What a trace shares (norms, peaks) are windows over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelake.functions import trace

Adjoint = Callable[[DataFrame], DataFrame]


def l1(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    return pairs.withColumn("adjoint", F.signum(F.col("syn") - F.col("obs")) * dt)


def l2(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    """The residual over its trace's norm; 0 where they agree."""
    r = F.col("syn") - F.col("obs")
    norm = F.sqrt(F.sum(r * r * dt).over(trace.whole()))
    return pairs.withColumn("adjoint", F.coalesce(r * dt / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def smooth_l1(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    return pairs.withColumn("adjoint", F.greatest(F.least(F.col("syn") - F.col("obs"), F.lit(1.0)), F.lit(-1.0)) * dt)


def student_t(pairs: DataFrame, s: float = 1.0, sigma: float = 1.0, dt: float = 1.0) -> DataFrame:
    r = F.col("syn") - F.col("obs")
    return pairs.withColumn("adjoint", (s + 1) * r / (s * sigma * sigma + r * r) * dt)


def of_peaks(pairs: DataFrame, adjoint: Adjoint) -> DataFrame:
    """The misfit's of traces over their peaks, carried through the division; dead synthetics have 0. Where samples share
    the peak, the first one counts as it."""
    peaks = pairs.select("*", F.col("syn").alias("syn_"), F.col("obs").alias("obs_"), F.max(F.abs("syn")).over(trace.whole()).alias("top_"))
    first = F.min(F.when(F.abs("syn") == F.col("top_"), F.col("it"))).over(trace.whole())
    over = F.max(F.abs("obs")).over(trace.whole())
    scaled = peaks.withColumn("first_", first).withColumn("syn", F.col("syn") / F.nullif("top_", F.lit(0.0))).withColumn("obs", F.coalesce(F.col("obs") / F.nullif(over, F.lit(0.0)), F.lit(0.0)))
    made = adjoint(scaled.withColumn("syn", F.coalesce("syn", F.lit(0.0))))
    pull = F.sum(F.col("adjoint") * F.col("syn_")).over(trace.whole()) * F.signum("syn_") / (F.col("top_") * F.col("top_"))
    out = F.col("adjoint") / F.col("top_") - F.when(F.col("it") == F.col("first_"), pull).otherwise(0.0)
    made = made.withColumn("adjoint", F.when(F.col("top_") > 0, out).otherwise(0.0))
    return made.withColumn("syn", F.col("syn_")).withColumn("obs", F.col("obs_")).select(*pairs.columns, "adjoint")
