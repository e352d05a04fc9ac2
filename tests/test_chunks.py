"""Operators with carried state: any chunking, order of arrival, repeats, gaps and restarts give the batch operator's values."""

import math
import tempfile

import numpy as np
import pytest

from wavelake.functions.carried import LowPass, RunningSum, Unwrap, applied
from wavelake.streaming.chunks import carried, chunk_stream, written

KERNELS = {"sum": RunningSum(0.5), "unwrap": Unwrap(), "low_pass": LowPass(6, 100, 16)}
SCHEMA = "trace bigint, first bigint, amp array<double>, ts timestamp"


def plain(kind, x):
    y, fixed = [], 0.0
    if kind == "sum":
        return np.cumsum(x) * 0.5
    if kind == "unwrap":
        return np.unwrap(x)
    (b0, b1, b2), (_, a1, a2) = KERNELS["low_pass"].coefficients
    for k in range(len(x)):
        at = lambda v, i: v[i] if i >= 0 else 0.0
        y.append(b0 * x[k] + b1 * at(x, k - 1) + b2 * at(x, k - 2) - a1 * at(y, k - 1) - a2 * at(y, k - 2))
    return np.array(y)


@pytest.mark.parametrize("kind", KERNELS)
def test_cuts(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300) * 4
    want = plain(kind, x)
    for cuts in ([], [1], [16, 17, 32], [299], sorted(rng.choice(300, 40).tolist())):
        state, got = list(KERNELS[kind].start), []
        for part in np.split(x, cuts):
            y, state = KERNELS[kind](part, state)
            got.append(y)
        assert np.allclose(np.concatenate(got), want, atol=1e-9)


def test_low_pass_passes_and_stops():
    t = np.arange(2000) / 100
    tail = slice(1000, None)
    slow, fast = (LowPass(6, 100)(np.sin(2 * math.pi * f * t), [0.0, 0.0])[0][tail] for f in (0.5, 40))
    assert np.abs(slow).max() > 0.98 and np.abs(fast).max() < 0.01
    with pytest.raises(ValueError):
        LowPass(60, 100)


def test_applied(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "rcv bigint, amp array<double>")
    assert {r.rcv: r.amp for r in applied(rows, RunningSum()).collect()} == {1: [1.0, 3.0], 2: None, 3: []}


def folders():
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def put(spark, folder, rows):
    frame = spark.createDataFrame(rows, "trace bigint, first bigint, amp array<double>, at double").selectExpr("trace", "first", "amp", "timestamp_seconds(at) AS ts")
    frame.coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint, kernel, late="1 second", patience_ms=10_000):
    stream = chunk_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    written(carried(stream, kernel, ["trace"], late, patience_ms), out, checkpoint).awaitTermination()
    made = {}
    for r in spark.read.parquet(out).collect():
        for k, v in enumerate(r.amp):
            assert (r.trace, r.first + k) not in made
            made[r.trace, r.first + k] = v
    return made


def test_stream_out_of_order_repeats_restart(spark):
    """Three traces in uneven chunks, shuffled over the files, some twice and some overlapping; stopped and started again."""
    rng = np.random.default_rng(5)
    traces = {t: rng.normal(size=n) * 3 for t, n in ((1, 60), (2, 41), (3, 1))}
    rows = []
    for t, x in traces.items():
        edges = [0, *sorted(rng.choice(np.arange(1, len(x)), min(7, len(x) - 1), replace=False).tolist()), len(x)]
        rows += [(t, a, x[a:b].tolist(), float(b)) for a, b in zip(edges, edges[1:], strict=False)]
    rows += [(1, 5, traces[1][5:25].tolist(), 25.0), rows[0], (2, None, [1.0], 1.0), (2, 3, None, 1.0)]
    rng.shuffle(rows)
    rows = [(int(a), None if b is None else int(b), c, float(d)) for a, b, c, d in rows]
    folder, out, checkpoint = folders()
    kernel = LowPass(6, 100, 8)
    put(spark, folder, rows[:7])
    put(spark, folder, rows[7:13])
    run(spark, folder, out, checkpoint, kernel, "1 day", 86_400_000)
    put(spark, folder, rows[13:])
    got = run(spark, folder, out, checkpoint, kernel, "1 day", 86_400_000)
    want = {(t, k): v for t, x in traces.items() for k, v in enumerate(kernel(x, [0.0, 0.0])[0])}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_stream_gives_gaps_up(spark):
    """Samples 2 and 3 don't come in time: zeros stand for them, and they are ignored later; a late trace isn't held up."""
    folder, out, checkpoint = folders()
    put(spark, folder, [(1, 0, [1.0, 1.0], 1.0), (1, 4, [1.0], 2.0)])
    put(spark, folder, [(2, 0, [1.0], 100.0)])
    put(spark, folder, [(2, 1, [1.0], 200.0)])
    put(spark, folder, [(1, 2, [5.0, 5.0], 300.0), (1, 5, [1.0], 300.0)])
    got = run(spark, folder, out, checkpoint, RunningSum())
    assert got == {(1, 0): 1.0, (1, 1): 2.0, (1, 4): 3.0, (1, 5): 4.0, (2, 0): 1.0, (2, 1): 2.0}
