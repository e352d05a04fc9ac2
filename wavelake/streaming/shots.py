"""Shots as a stream: losses and gradients added up batch by batch, misfits in event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wavelake.sources.store import children, exists, publish


def shot_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, a mini-batch of shots for so many files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def accumulate(stream: DataFrame, misfit: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """(shot, rcv, obs, syn samples) -> a table of (batch, shot, misfit): each batch's losses in a folder of its own.

    A batch that runs again after a failure writes the same folder over, so its losses count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        misfit(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """shot, misfit over all batches."""
    return spark.read.parquet(f"{out}/batch=*").groupBy("shot").agg(F.sum("misfit").alias("misfit"))


def windowed_energy(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(ts, trace, value), a stream or a table -> window start, trace, n, energy; later rows than `late` are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = timed.groupBy(F.window("ts", width), "trace").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy"))
    return made.select(F.col("window.start").alias("start"), "trace", "n", "energy")


# ---------------------------------------------------------------- gradients


def accumulate_gradients(stream: DataFrame, gradient: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """gradient makes (iz, ix, grad) of a batch; out gets their sums, each batch once. A batch's sums are a folder of its
    number, which a repeated batch writes over; after `every` batches they are added up to a total that is named by the
    last of them. A total counts once it is whole, and stands for all batches up to its number."""

    def write(batch: DataFrame, number: int) -> None:
        gradient(batch).groupBy("iz", "ix").agg(F.sum("grad").alias("grad")).write.mode("overwrite").parquet(f"{out}/batch-{number:09d}")
        if (number + 1) % every == 0:
            compact(batch.sparkSession, out, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, out: str, number: int) -> None:
    """One table for all batches up to that number; written aside and renamed, so that none is seen half done."""
    staged, target = f"{out}/staged-{uuid.uuid4().hex}", f"{out}/total-{number:09d}"
    if not exists(spark, target):
        gradient_total(spark, out, number).write.parquet(staged)
        publish(spark, staged, target)


def gradient_total(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """iz, ix, grad: the sum over all batches (up to a number): the newest total and the batches after it."""
    numbered = {kind: [int(n.removeprefix(kind)) for n in children(spark, out) if n.startswith(kind)] for kind in ("total-", "batch-")}
    if upto is not None:
        numbered = {kind: [n for n in own if n <= upto] for kind, own in numbered.items()}
    last = max(numbered["total-"], default=-1)
    paths = [f"{out}/total-{last:09d}"] * (last >= 0) + [f"{out}/batch-{n:09d}" for n in numbered["batch-"] if n > last]
    if not paths:
        return spark.createDataFrame([], "iz bigint, ix bigint, grad double")
    return spark.read.parquet(*paths).groupBy("iz", "ix").agg(F.sum("grad").alias("grad"))
