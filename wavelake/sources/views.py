"""Views: traces and observed/synthetic pairs as array rows or samples, grids as cells; readers and writers of them.

A trace stays one row with an array until an operator needs its samples, so pairing shuffles rows, not samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) -> shot, rcv, amp (array<double>)."""
    return vectors.select(F.col("label").cast("long").alias("shot"), F.col("vec_id").alias("rcv"), F.col("embedding").cast("array<double>").alias("amp"))


def samples(traces: DataFrame, *columns: str) -> DataFrame:
    """Array rows -> one row for each sample, numbered by `it` from 0."""
    keys = [c for c in traces.columns if c not in columns]
    if len(columns) == 1:
        return traces.select(*keys, F.posexplode(columns[0]).alias("it", columns[0])).withColumn("it", F.col("it").cast("long"))
    return traces.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("it", "z")).select(*keys, F.col("it").cast("long").alias("it"), *(f"z.{c}" for c in columns))


def pair_rows(traces: DataFrame) -> DataFrame:
    """shot, rcv, obs, syn (arrays): even receivers are observed, the next odd one is its synthetic."""
    obs = traces.where("rcv % 2 = 0").withColumnRenamed("amp", "obs")
    syn = traces.where("rcv % 2 = 1").select((F.col("rcv") - 1).alias("rcv"), F.col("amp").alias("syn"))
    return obs.join(syn, "rcv").select("shot", "rcv", "obs", "syn")


def unmatched(observed: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Traces that only one side has: shot, rcv, missing ('observed' or 'synthetic')."""
    a = observed.select("shot", "rcv", F.lit(True).alias("o"))
    b = synthetic.select("shot", "rcv", F.lit(True).alias("s"))
    both = a.join(b, ["shot", "rcv"], "full_outer").where("o IS NULL OR s IS NULL")
    return both.select("shot", "rcv", F.when(F.col("o").isNull(), "observed").otherwise("synthetic").alias("missing"))


def grid_cells(vectors: DataFrame) -> DataFrame:
    """The vectors as a matrix: iz (place in the vector), ix (vec_id), v."""
    return vectors.select(F.col("vec_id").alias("ix"), F.posexplode(F.col("embedding").cast("array<double>")).alias("iz", "v")).select(F.col("iz").cast("long").alias("iz"), "ix", "v")


def save_gathers(traces: DataFrame, path: str) -> None:
    """Shot gathers as Parquet, partitioned by component if there is one."""
    writer = traces.write.mode("errorifexists")
    (writer.partitionBy("component") if "component" in traces.columns else writer).parquet(path)


def load_gathers(spark: SparkSession, path: str, shots: tuple[int, int] | None = None) -> DataFrame:
    """Gathers, of a shot range [first, last) if given; the range reaches the scan."""
    read = spark.read.parquet(path)
    return read if shots is None else read.where((F.col("shot") >= shots[0]) & (F.col("shot") < shots[1]))


def record(*components: DataFrame) -> DataFrame:
    """Components (shot, rcv, component, amp) as one table."""
    out = components[0]
    for c in components[1:]:
        out = out.unionByName(c)
    return out


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A text file of whitespace-separated numbers, one file row for each grid row -> iz, ix, v.

    Rows are numbered within each file by their order in it; a file is read by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\n")).alias("iz", "line"))
    return lines.select(F.col("iz").cast("long"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("ix", "x")).select("iz", F.col("ix").cast("long").alias("ix"), F.col("x").cast("double").alias("v"))


def sources(spark: SparkSession, xs: list[int], zs: list[int], kind: str = "mt") -> DataFrame:
    """shot, sx, sz, type."""
    if len(xs) != len(zs):
        raise ValueError("as many x as z are needed")
    return spark.createDataFrame([(i, x, z, kind) for i, (x, z) in enumerate(zip(xs, zs, strict=True))], "shot bigint, sx bigint, sz bigint, type string")


def receivers(spark: SparkSession, xs: list[int], zs: list[int], kind: str = "pr") -> DataFrame:
    """rcv, rx, rz, type ('pr', 'vx' or 'vz')."""
    if kind not in ("pr", "vx", "vz"):
        raise ValueError(f"unknown receiver type {kind}")
    return spark.createDataFrame([(i, x, z, kind) for i, (x, z) in enumerate(zip(xs, zs, strict=True))], "rcv bigint, rx bigint, rz bigint, type string")


def acquisition(shots: DataFrame, receivers_: DataFrame, most: int) -> DataFrame:
    """The receivers within `most` of each shot along x, with their offset: the geometry of a spread that moves along.

    Receivers stand in bins of that width and a shot asks its own and the two beside it, so the join is by bin; its size is
    what the survey records."""
    bin_ = lambda x: F.floor(x / F.lit(most + 1))
    own = receivers_.select("rcv", "rx", "rz", bin_(F.col("rx")).alias("bin_"))
    asked = shots.withColumn("bin_", F.explode(F.sequence(bin_(F.col("sx")) - 1, bin_(F.col("sx")) + 1)))
    return asked.join(own, "bin_").drop("bin_").withColumn("offset", F.abs(F.col("rx") - F.col("sx"))).where(F.col("offset") <= most)


def survey_summary(places: DataFrame, x: str = "sx", z: str = "sz") -> DataFrame:
    """Number, extent and types of sources, or of receivers (x='rx', z='rz')."""
    return places.agg(F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def source_wavelets(shots: DataFrame) -> DataFrame:
    """(shot, wavelet as an array) -> shot, it, amp."""
    return samples(shots.select("shot", F.col("wavelet").alias("amp")), "amp")


def moment_tensors(shots: DataFrame) -> DataFrame:
    """(shot, mt as rows of three) -> shot, i, j, m."""
    rows = shots.select("shot", F.posexplode("mt").alias("i", "row"))
    return rows.select("shot", F.col("i").cast("long"), F.posexplode("row").alias("j", "m")).withColumn("j", F.col("j").cast("long"))
