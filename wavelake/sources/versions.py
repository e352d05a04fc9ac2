"""Keyed tables that grow by appends: staged files, a manifest for each version, and appends that may be repeated or race.

A version is one small file that lists the parts (folders of Parquet) which make up the table; the next version is the same list and one
part more, and appears by one rename that never overwrites. Whoever loses that race looks again: its rows are checked
against what is there now, and it tries to be the version after. Readers hold on to the version that they opened.

Rows whose key is there with the same values are left out, so a repeated append changes nothing; a key that is there with
other values, or twice among the new rows, is refused, as are null keys, and nothing of that append is seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelake.sources.store import children, publish

#: Times that an append tries to be the next version.
TRIES = 100
#: Looks at (what is there, the new rows) and raises where they don't fit.
Check = Callable[[DataFrame, DataFrame], None]


class VersionedTable:
    """A table under a shared path, with a key and a schema that stay."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in children(self.spark, f"{self.path}/versions") if name.endswith(".json")]

    def parts(self, version: int) -> list[str]:
        if not version:
            return []
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:08d}.json", wholetext=True).first()[0])["parts"]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is given."""
        parts = self.parts(max(self.versions(), default=0) if version is None else version)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def append(self, rows: DataFrame, check: Check | None = None) -> int:
        """The version that holds the rows. They are written once; each try compares their keys with what is there."""
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        rows = self.spark.read.schema(self.schema).parquet(staged)
        null = " OR ".join(f"{k} IS NULL" for k in self.keys)
        if not rows.where(null).isEmpty():
            raise ValueError(f"null keys: {self.keys}")
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys that come twice: {self.keys}")
        for _ in range(TRIES):
            version = max(self.versions(), default=0)
            there = self.read(version)
            if check:
                check(there, rows)
            fresh = self.fresh(rows, there)
            if fresh.isEmpty():
                return version
            part = uuid.uuid4().hex
            fresh.write.parquet(f"{self.path}/parts/{part}")
            manifest = f"{self.path}/staged/{part}"
            self.spark.createDataFrame([(json.dumps({"parts": [*self.parts(version), part]}),)], "value string").coalesce(1).write.text(manifest)
            file = next(n for n in children(self.spark, manifest) if n.startswith("part-"))
            if publish(self.spark, f"{manifest}/{file}", f"{self.path}/versions/{version + 1:08d}.json"):
                return version + 1
        raise RuntimeError(f"{TRIES} other appends came first")

    def fresh(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        """The rows whose keys aren't there."""
        others = [f.name for f in self.schema.fields if f.name not in self.keys]
        held = there.select(*self.keys, F.struct(*others).alias("old_") if others else F.lit(True).alias("old_"), F.lit(True).alias("is_there"))
        met = rows.withColumn("new_", F.struct(*others) if others else F.lit(True)).join(held, self.keys, "left")
        if not met.where("is_there AND NOT (old_ <=> new_)").isEmpty():
            raise ValueError("keys that are there with other values")
        return met.where("is_there IS NULL").select(*self.schema.fieldNames())


SOURCES = "shot bigint, sx bigint, sz bigint, type string, wavelet array<double>, mt array<array<double>>"
RECEIVERS = "rcv bigint, rx bigint, rz bigint, type string"


def fits_sources(there: DataFrame, rows: DataFrame) -> None:
    """Sources are moment tensors of three by three, with wavelets of one length, that of those already there."""
    lengths = there.unionByName(rows).select(F.coalesce(F.size("wavelet"), F.lit(-1)).alias("n")).distinct().limit(3).collect()
    if len(lengths) > 1 or any(r.n < 1 for r in lengths):
        raise ValueError("wavelets must have one length")
    wide = F.coalesce((F.size("mt") == 3) & F.forall("mt", lambda row: F.size(row) == 3), F.lit(False))
    if not rows.where((F.lower("type") != "mt") | F.col("type").isNull() | ~wide).isEmpty():
        raise ValueError("sources are of type mt and have a moment tensor of three by three")


def fits_receivers(there: DataFrame, rows: DataFrame) -> None:
    if not rows.where("type IS NULL OR lower(type) NOT IN ('pr', 'vx', 'vz')").isEmpty():
        raise ValueError("receivers are of type pr, vx or vz")


def source_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SOURCES, ["shot"])


def receiver_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, RECEIVERS, ["rcv"])
