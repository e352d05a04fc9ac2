"""Imaging conditions on stored wavefields: products of a forward and an adjoint field, summed over shots and times.

Fields (shot, it, iz, ix, p) are stored once in buckets by their whole key. Two fields with as many buckets meet bucket by
bucket: neither is shuffled, and what moves are each task's partial sums by cell. A shot of any size is spread over all buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.operators.grid import with_scalar
from wavelake.sources.store import fresh_path

KEY = ["shot", "it", "iz", "ix"]


def store_field(field: DataFrame, buckets: int) -> str:
    """Writes a field (each key once) to the shared folder, and gives its table's name in the catalog of the session."""
    spark, name = field.sparkSession, f"field_{uuid.uuid4().hex}"
    dealt = field.select(*(F.col(k).cast("long") for k in KEY), F.col("p").cast("double").alias("p")).repartition(buckets, *KEY)
    dealt.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", fresh_path(spark, "field")).saveAsTable(name)
    return name


def met(spark: SparkSession, forward: str, adjoint: str) -> DataFrame:
    """shot, it, iz, ix, p (forward), a (adjoint) where both have a value."""
    return spark.table(forward).join(spark.table(adjoint).withColumnRenamed("p", "a").hint("merge"), KEY)


def cross_correlation(spark: SparkSession, forward: str, adjoint: str, dt: float = 1.0) -> DataFrame:
    """iz, ix, image: the sum of the products of both fields, times dt."""
    return met(spark, forward, adjoint).groupBy("iz", "ix").agg((F.sum(F.col("p") * F.col("a")) * dt).alias("image"))


def illuminated(spark: SparkSession, forward: str, adjoint: str, water: float = 1e-4) -> DataFrame:
    """iz, ix, image: the products over the forward field's energy, where that is `water` of its largest at least."""
    sums = met(spark, forward, adjoint).groupBy("iz", "ix").agg(F.sum(F.col("p") * F.col("a")).alias("image"), F.sum(F.col("p") * F.col("p")).alias("energy"))
    held = with_scalar(sums, F.max("energy"), "top")
    return held.select("iz", "ix", (F.col("image") / F.nullif(F.greatest("energy", water * F.col("top")), F.lit(0.0))).alias("image"))
