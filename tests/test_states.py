"""What survives a lost driver: versions of tables, sums of batches, a descent's state; and fields that aren't shuffled."""

import math
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wavelake.operators import imaging
from wavelake.plans import descent, reverse
from wavelake.sources import versions
from wavelake.sources.store import children
from wavelake.streaming import shots


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def receivers(spark, a, b, kind="pr", shift=0):
    return spark.range(a, b).selectExpr("id AS rcv", f"2 * id + {shift} AS rx", "1 AS rz", f"'{kind}' AS type")


def test_appends(spark):
    table = versions.receiver_table(spark, f"file://{fresh()}/r")
    assert table.read().count() == 0
    assert table.append(receivers(spark, 0, 5), versions.fits_receivers) == 1
    assert table.append(receivers(spark, 0, 5)) == 1  # again: nothing new
    assert table.append(receivers(spark, 3, 8, "pr")) == 2 and table.read().count() == 8 and table.read(1).count() == 5
    for bad, rows in (("other values", receivers(spark, 7, 9, shift=1)), ("twice", receivers(spark, 20, 22).union(receivers(spark, 21, 22))), ("null", receivers(spark, 30, 31).withColumn("rcv", F.lit(None).cast("long")))):
        with pytest.raises(ValueError, match=bad):
            table.append(rows)
    with pytest.raises(ValueError, match="pr, vx or vz"):
        table.append(receivers(spark, 40, 41, "zz"), versions.fits_receivers)
    assert table.read().count() == 8 and table.versions() == [1, 2]
    assert versions.receiver_table(spark, table.path).read().where("rcv = 7").first().rx == 14


def test_appends_at_the_same_time(spark):
    """Overlapping appends from several threads: each key once, as many versions as there was something new."""
    path = f"{fresh()}/r"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: versions.receiver_table(spark, path).append(receivers(spark, 5 * k, 5 * k + 10)), [0, 1, 2, 3]))
    table = versions.receiver_table(spark, path)
    assert sorted(r.rcv for r in table.read().collect()) == list(range(25)) and 1 <= len(table.versions()) <= 4


def test_sources_share_their_length(spark):
    def sources(a, b, nt=3, mt="array(array(1D, 0D, 0D), array(0D, 1D, 0D), array(0D, 0D, 1D))", kind="mt"):
        return spark.range(a, b).selectExpr("id AS shot", "id AS sx", "1 AS sz", f"'{kind}' AS type", f"array_repeat(0.5D, {nt}) AS wavelet", f"{mt} AS mt")

    table = versions.source_table(spark, f"{fresh()}/s")
    table.append(sources(0, 3), versions.fits_sources)
    for bad in (sources(3, 4, 4), sources(3, 4, 0), sources(3, 4, mt="array(array(1D))"), sources(3, 4, mt="null"), sources(3, 4, kind="ex")):
        with pytest.raises(ValueError):
            table.append(bad, versions.fits_sources)
    assert table.append(sources(3, 4), versions.fits_sources) == 2 and table.read().count() == 4


def test_gradients_of_batches(spark):
    """Ten batches, totals of three; one batch replayed and a total made again change nothing."""
    base = fresh()
    rows = spark.range(200).selectExpr("id % 7 AS iz", "id % 3 AS ix", "id * 1.5D AS grad")
    for k in range(10):
        rows.where(f"pmod(hash(grad), 10) = {k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = shots.shot_stream(spark, f"{base}/in", "iz bigint, ix bigint, grad double")
    shots.accumulate_gradients(stream, lambda b: b, f"{base}/out", f"{base}/check", every=3).awaitTermination()
    names = children(spark, f"{base}/out")
    assert len([n for n in names if n.startswith("batch-")]) == 10 and [n for n in names if n.startswith("total-")] == ["total-000000002", "total-000000005", "total-000000008"]
    want = {(r.iz, r.ix): r.g for r in rows.groupBy("iz", "ix").agg(F.sum("grad").alias("g")).collect()}
    same = lambda: all(math.isclose(want[r.iz, r.ix], r.grad) for r in shots.gradient_total(spark, f"{base}/out").collect())
    assert same() and shots.gradient_total(spark, f"{base}/out").count() == len(want)
    replayed = spark.createDataFrame(spark.read.parquet(f"{base}/out/batch-000000009").collect())
    replayed.write.mode("overwrite").parquet(f"{base}/out/batch-000000009")
    shots.compact(spark, f"{base}/out", 8)
    assert same() and shots.gradient_total(spark, f"{fresh()}/none").count() == 0


def objective_of(counter):
    weight = F.pow(F.lit(3.0), F.col("i"))

    def objective(point):
        counter.append(1)
        made = point.select("i", (weight * (F.col("v") - F.col("i"))).alias("grad"), (weight * (F.col("v") - F.col("i")) * (F.col("v") - F.col("i")) / 2).alias("l"))
        return float(made.agg(F.sum("l")).first()[0]), made.select("i", "grad")

    return objective


def test_reverse_communication(spark):
    """A caller lost after every single evaluation, some told twice, has the iterates of the plain descent."""
    start = spark.range(5).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    asked = []
    point, losses = descent.minimise(objective_of(asked), start, "lbfgs", iterations=3, memory=2, tolerance=0.0)
    path, told = f"{fresh()}/d", []
    reverse.Descent(spark, path, memory=2).begin(start)
    objective = objective_of(told)
    while len(reverse.Descent(spark, path, memory=2).point()[1]) < 4:
        one = reverse.Descent(spark, path, memory=2)
        k, at = one.ask()
        loss, grad = objective(at)
        one.tell(k, loss, grad)
        if k % 3 == 0:
            one.tell(k, loss + 1, grad)
        one.begin(start)
    found, own = reverse.Descent(spark, path, memory=2).point()
    assert len(asked) == len(told) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(own, losses, strict=True))
    want = {r.i: r.v for r in point.collect()}
    assert all(math.isclose(r.v, want[r.i], rel_tol=1e-12) for r in found.collect())


def test_fields_meet_in_buckets(spark):
    """No exchange of the fields: only the partial sums by cell move."""
    field = spark.range(4000).selectExpr("id % 5 AS shot", "id div 5 % 10 AS it", "id div 50 % 8 AS iz", "id div 400 AS ix", "id / 7D AS p")
    names = imaging.store_field(field, 4), imaging.store_field(field.withColumn("p", F.col("p") * 2), 4)
    image = imaging.cross_correlation(spark, *names)
    plan = image._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Exchange hashpartitioning(iz" in plan
    want = {(r.iz, r.ix): r.v for r in field.groupBy("iz", "ix").agg(F.sum(2 * F.col("p") * F.col("p")).alias("v")).collect()}
    assert all(math.isclose(r.image, want[r.iz, r.ix]) for r in image.collect()) and image.count() == len(want)
