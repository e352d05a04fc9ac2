"""What the operators share: the cluster's shared folder, saved tables and byte-level word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch that carries whole texts.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set and all run
    in one process (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavelake-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


#: Paths of the tables saved in each open scratch(), the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def save(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors.

    Inside scratch() the table goes when that ends; with outlive, when the next outer one does.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    scopes = _scopes.get()[: -1 if outlive else None]
    if scopes:
        scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that save() writes in here are deleted at the end, once what they led to is written itself."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fold_of(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id's text modulo parts; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sql_lower(text: str) -> str:
    """SQL that lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate({text}, '{upper}', '{upper.lower()}')"


def bounded(operator: Callable) -> Callable:
    """For operators that hand whole texts to Python: the session's Arrow batches become BATCH_ROWS rows and BATCH_BYTES
    bytes at most, so that a batch of long texts fits in a worker."""

    @wraps(operator)
    def run(df: DataFrame, *args, **named):
        conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
        if int(conf.get(rows)) > BATCH_ROWS:
            conf.set(rows, str(BATCH_ROWS))
        if not (set_ := conf.get(size)).removesuffix("b").isdigit() or int(set_.removesuffix("b")) > BATCH_BYTES:
            conf.set(size, str(BATCH_BYTES))
        return operator(df, *args, **named)

    return run


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]



def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])
