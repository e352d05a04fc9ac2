"""Traces that come in chunks: operators whose state lives across chunks, in any order of arrival.

A chunk is a row of keys, `first` (the number of its first sample in its trace), `amp` (its samples) and `ts`, the time
by which it was recorded. Chunks that are next are worked on at once, others wait in the state for those before them.
Samples that were already there are ignored, so a chunk that comes twice, or overlaps one, counts once. If a gap isn't
filled until the watermark is `patience` behind the first waiting chunk, an event-time timer gives it up: its samples
count as zeros, aren't put out, and are ignored when they come after all.

State of a trace: the next sample's number, the kernel's few numbers, and what waits; a stream may be stopped and started
again from its checkpoint at any time. What waits behind a gap at the end of a stream stays in the state.
Rows of null first, amp or ts are ignored; a null key is a key.

A group of Spark's state is a bucket of traces (by a hash of their keys), not one trace: its state is read once and written
once a batch, for all its traces, so that calls to the state store don't grow with traces. A worker holds one bucket's
states and its chunks of a batch. Buckets are fixed when a stream first starts; a stream can't go on with another number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wavelake.functions.carried import Kernel

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples of a gap that are worked on at a time.
GAP_BLOCK = 1 << 16
#: Buckets that share out the traces: many more than tasks, and few enough that a bucket has many traces.
BUCKETS = 1024
#: Keys go through Python and its state as JSON, which keeps all of their values.
AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass
class Trace:
    """What is next, the kernel's state, and chunks that wait: first -> (samples, due)."""

    next_: int
    carry: list[float]
    waits: dict[int, tuple[list[float], int]] = field(default_factory=dict)

    def due(self) -> int | None:
        """When the gap before the first waiting chunk is given up."""
        return self.waits[min(self.waits)][1] if self.waits else None


class Carried(StatefulProcessor):
    """One bucket of traces."""

    def __init__(self, kernel: Kernel) -> None:
        self.kernel = kernel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.traces = handle.getListState("traces", "key string, next bigint, carry array<double>, waits array<struct<first: bigint, amp: array<double>, due: bigint>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        traces, touched = self.held(), {}
        for row in rows:
            if row.first is None or row.amp is None or row.due_ is None:
                continue
            trace = touched[row.key_] = traces.setdefault(row.key_, Trace(0, list(self.kernel.start)))
            if row.first not in trace.waits or len(row.amp) > len(trace.waits[row.first][0]):
                trace.waits[row.first] = (row.amp, row.due_)
        for name, trace in touched.items():
            yield from self.advanced(name, trace)
        if touched:
            self.keep(traces)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """The gap before a trace's first waiting chunk counts as zeros, if that chunk's own time has come."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        traces = self.held()
        for name, trace in traces.items():
            if trace.waits and trace.due() <= now:
                while trace.next_ < min(trace.waits):
                    n = min(GAP_BLOCK, min(trace.waits) - trace.next_)
                    _, trace.carry = self.kernel(np.zeros(n), trace.carry)
                    trace.next_ += n
                yield from self.advanced(name, trace)
        self.keep(traces)

    def held(self) -> dict[str, Trace]:
        return {k: Trace(next_, list(carry), {w[0]: (list(w[1]), w[2]) for w in waits}) for k, next_, carry, waits in self.traces.get()}

    def advanced(self, name: str, trace: Trace) -> Iterator[Row]:
        """Works on what is next; the rest waits."""
        for first in sorted(trace.waits):
            if first > trace.next_:
                break
            fresh = np.array(trace.waits.pop(first)[0][trace.next_ - first :], float)
            if len(fresh):
                y, trace.carry = self.kernel(fresh, trace.carry)
                yield Row(key_=name, first=trace.next_, amp=y.tolist())
                trace.next_ += len(fresh)

    def keep(self, traces: dict[str, Trace]) -> None:
        """Writes the state, and sets a timer for the first that waits."""
        self.traces.put([(k, t.next_, list(t.carry), [(first, list(amp), due) for first, (amp, due) in t.waits.items()]) for k, t in traces.items()])
        due = min((t.due() for t in traces.values() if t.waits), default=None)
        if due is not None and due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def carried(chunks: DataFrame, kernel: Kernel, keys: list[str], late: str = "1 hour", patience_ms: int = 3_600_000, buckets: int = BUCKETS) -> DataFrame:
    """(keys, first, amp, ts), a stream or a table -> keys, first, amp: the kernel's values, in chunks without overlaps."""
    timed = chunks.select(*keys, F.col("first").cast("long"), F.col("amp").cast("array<double>"), F.col("ts").cast("timestamp")).withWatermark("ts", late)
    named = F.struct(*((F.col(k) + F.lit(0.0).cast(kind)).alias(k) if (kind := timed.schema[k].dataType.typeName()) in ("float", "double") else F.col(k) for k in keys))  # -0.0 is 0.0
    told = timed.select(F.to_json(named, AS_JSON).alias("key_"), "first", "amp", "ts", (F.unix_millis("ts") + patience_ms).alias("due_"))
    shared = told.withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(buckets)))
    made = shared.groupBy("bucket_").transformWithState(Carried(kernel), "key_ string, first bigint, amp array<double>", "Append", "EventTime")
    return made.select(F.from_json("key_", T.StructType([timed.schema[k] for k in keys]), AS_JSON).alias("key_"), "first", "amp").select(*(F.col("key_").getField(k).alias(k) for k in keys), "first", "amp")


def written(made: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The stream as a Parquet table, each row exactly once, over all that is there by now. A query reads the state provider
    from its session when it starts; the session's own is put back then."""
    conf = made.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return made.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)


def chunked(samples: DataFrame, keys: list[str], order: list[str], v: str, ts: str, size: int) -> DataFrame:
    """Irregular samples -> chunks of `size` samples of each trace, numbered by their order; ts is the last one's."""
    from pyspark.sql import Window

    placed = samples.withColumn("it_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    cut = placed.groupBy(*keys, F.floor(F.col("it_") / size).alias("chunk_"))
    made = cut.agg(F.array_sort(F.collect_list(F.struct("it_", v))).alias("s_"), F.max(ts).alias("ts"))
    return made.select(*keys, (F.col("chunk_") * size).alias("first"), F.transform("s_", lambda s: s[v].cast("double")).alias("amp"), F.col("ts").cast("timestamp").alias("ts"))


def chunk_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """The chunks in a folder's Parquet files, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
