"""Exact quantiles by key in bounded state: a sketch finds a narrow range of values that holds the quantile, counts settle it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy of the sketch (its size), keys that a key's rows are dealt to, and rows within bounds that are counted out.
ACCURACY, SALTS, MOST = 1000, 64, 1 << 20


def by_salted_key(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the table's columns (one row of it for each key): a key's rows are dealt to SALTS keys."""
    salted = table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt_"]).drop("salt_")


def narrowed(rows: DataFrame, bounds: DataFrame | None, keys: list[str], share: float, margin: float) -> DataFrame:
    """(keys, v) and bounds -> keys, n (all rows), low, high (narrower bounds), under (rows below them) and inside. low and
    high are values of the sketch, a margin of ranks below and above the quantile's."""
    if bounds is None:
        held = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), ACCURACY).alias("ab"))
        return held.select(*keys, "n", F.when(F.lit(share) <= margin, F.col("low")).otherwise(F.col("ab")[0]).alias("low"), F.when(F.lit(share) >= 1 - margin, F.col("high")).otherwise(F.col("ab")[1]).alias("high"))
    within = by_salted_key(rows, bounds, keys).where("v BETWEEN low AND high")
    spread = F.percentile_approx("v", F.array(*(F.lit(k / 64) for k in range(65))), ACCURACY)
    held = within.groupBy(*keys).agg(F.first("n").alias("n"), F.first("rank").alias("rank"), F.first("under").alias("under"), F.count("*").alias("inside"), spread.alias("at"))
    place = (F.col("rank") - F.col("under")) / F.greatest(F.col("inside") - 1, F.lit(1)) * 64
    low, high = F.greatest(F.floor(place) - 1, F.lit(0)).cast("int"), F.least(F.ceil(place) + 1, F.lit(64)).cast("int")
    return held.select(*keys, "n", F.get("at", low).alias("low"), F.get("at", high).alias("high"))


def counted(rows: DataFrame, bounds: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The bounds with rank (the quantile's, from 0, a fraction between two rows), under, inside and values within them."""
    met = by_salted_key(rows, bounds, keys)
    sums = met.groupBy(*keys).agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("inside"))
    return sums.withColumn("rank", F.lit(share) * (F.col("n") - 1))


def exact_quantile(samples: DataFrame, keys: list[str], v: Column, share: float, name: str, settle=lambda df: df) -> DataFrame:
    """keys, name: the exact quantile of v by key, linear between two rows where it lies between them. Null and NaN values don't count.

    A sketch of bounded size gives bounds; how many rows lie below and within them is counted. Bounds that hold more than
    MOST rows of more than one value are narrowed again; bounds that miss the quantile, which a sketch's error may cause,
    are widened to all values. What is within is then counted by value, and the two rows of the quantile's rank are picked.
    `settle` writes a small table for reuse (a checkpoint, for instance).
    """
    rows = samples.select(*keys, v.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    bounds = settle(counted(rows, narrowed(rows, None, keys, share, 4 / ACCURACY), keys, share))
    while True:
        held = (F.col("under") <= F.floor("rank")) & (F.ceil("rank") < F.col("under") + F.col("inside"))
        large = (F.col("inside") > MOST) & (F.col("low") < F.col("high"))
        before = bounds.agg(F.max(F.when(held & large, F.col("inside")))).first()[0]
        if before is None:
            break
        tighter = settle(counted(rows, narrowed(rows, bounds, keys, share, 0), keys, share))
        better = tighter.where(held)
        bounds = settle(better.unionByName(bounds.join(better.select(*keys), keys, "left_anti")))
        if bounds.agg(F.max(F.when(held & large, F.col("inside")))).first()[0] == before:
            break  # the sketch can't part what is left; the counts by value below still can
    missed = ~held
    final = bounds.select(*keys, "rank", *(F.when(missed, F.lit(x)).otherwise(F.col(c)).alias(c) for c, x in (("low", float("-inf")), ("high", float("inf")))))
    met = by_salted_key(rows, final, keys).where("v <= high")
    # values below the bounds are one group
    tally = met.groupBy(*keys, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("u")).agg(F.count("*").alias("m"), F.first("rank").alias("rank"))
    upto = tally.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("u"))))
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("u")))
    two = upto.groupBy(*keys).agg(first(F.floor("rank")).alias("a"), first(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    return two.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias(name))
