"""Traces share the state of their bucket: calls to the store don't grow with traces, and keys of all kinds come back."""

import math
import tempfile
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Row

from wavelake import queries
from wavelake.functions.carried import LowPass, RunningSum
from wavelake.sources.store import children
from wavelake.streaming.chunks import Carried, carried, chunk_stream, written


class Store:
    """A bucket's list state and timers, which counts calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, due):
        self.calls += 1
        self.timers.append(due)


def test_calls_to_the_store_do_not_grow_with_traces():
    seen = {}
    for n in (1, 500):
        store, got = Store(), {}
        bucket = Carried(RunningSum())
        bucket.init(store)
        for first in (4, 0, 2):
            rows = [Row(key_=str(t), first=first, amp=[1.0, 1.0], due_=10 + first) for t in range(n)]
            for r in bucket.handleInputRows((0,), iter(rows), None):
                got |= {(r.key_, r.first + k): v for k, v in enumerate(r.amp)}
        assert got == {(str(t), k): k + 1.0 for t in range(n) for k in range(6)}
        seen[n] = store.calls
    assert seen[500] == seen[1]


def test_a_timer_gives_up_all_gaps_of_the_bucket_that_are_due():
    store = Store()
    bucket = Carried(RunningSum())
    bucket.init(store)
    rows = [Row(key_=t, first=2, amp=[1.0], due_=due) for t, due in (("a", 10), ("b", 20), ("c", 90))]
    assert not list(bucket.handleInputRows((0,), iter(rows), None)) and store.timers == [10]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 30)
    made = list(bucket.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: 10)))
    assert sorted((r.key_, r.first, r.amp) for r in made) == [("a", 2, [1.0]), ("b", 2, [1.0])] and store.timers == [10, 90]


def streamed(spark, table, kernel, keys, **named):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    table.coalesce(1).write.parquet(f"{base}/in")
    made = carried(chunk_stream(spark, f"{base}/in", table.schema), kernel, keys, **named)
    written(made, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return made.columns, spark.read.parquet(f"{base}/out")


def test_keys_of_all_kinds(spark):
    """Null, not-a-number, negative zero (which is zero), large and quoted keys, two columns, one bucket for many traces."""
    rng = np.random.default_rng(7)
    keys = [(None, None, None), (2**62 + 1, 'a"b\\', 0.5), (2**62 + 2, "", math.nan), (-1, "é\n", 0.0), (3, None, -math.inf), *((k, "x", float(k)) for k in range(40))]
    kernel, rows, want = LowPass(6, 100, 8), [], {}
    for key in keys:
        x = rng.normal(size=30)
        want |= {(repr(key), k): v for k, v in enumerate(kernel(x, [0.0, 0.0])[0])}
        rows += [(*key[:2], -0.0 if key[2] == 0 and a == 10 else key[2], a, x[a : a + 10].tolist(), 1) for a in (20, 0, 10)]
    rows += [(1, "x", 1.0, None, [1.0], 1), (1, "x", 1.0, 0, None, 1), (1, "x", 1.0, 0, [9.0], None)]
    table = spark.createDataFrame(rows, "a bigint, b string, c double, first bigint, amp array<double>, at bigint").selectExpr("*", "timestamp_seconds(at) AS ts")
    columns, made = streamed(spark, table, kernel, ["a", "b", "c"], buckets=3)
    assert columns == ["a", "b", "c", "first", "amp"] and [t for _, t in made.dtypes[:3]] == ["bigint", "string", "double"]
    got = {(repr((r.a, r.b, r.c)), r.first + k): v for r in made.collect() for k, v in enumerate(r.amp)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_time_keys(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00.123456' AS t, timestamp_ntz'2024-01-01 00:00:00.123457' AS n, date'2024-02-03' AS d, X'00FF' AS b, 0L AS first, array(1D, 2D) AS amp, timestamp'2024-01-01' AS ts")
    _, made = streamed(spark, rows, RunningSum(), ["t", "n", "d", "b"])
    assert made.drop("first", "amp").collect() == rows.select("t", "n", "d", "b").collect()
    assert made.select("amp").first().amp == [1.0, 3.0]


def test_a_query_takes_four_batches_whatever_the_files(spark, small, monkeypatch):
    place = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/chunks"
    monkeypatch.setattr(queries, "fresh_path", lambda *_: place)
    assert queries.streamed(spark, small, RunningSum()).count() == spark.read.parquet(f"{small}/events.parquet").count()
    files = [name for name in children(spark, f"{place}/in") if name.endswith(".parquet")]
    assert len(files) > 8 and len([name for name in children(spark, f"{place}/checkpoint/commits") if name.isdigit()]) == 4
