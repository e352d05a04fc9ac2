"""Misfits between observed and synthetic traces.

Inputs are samples (shot, rcv, it, obs, syn) or array rows (shot, rcv, obs, syn). A misfit comes back by shot; add the
shots up for the total. Those that SQL can't express well are NumPy kernels over stacked traces: the pairs of a batch that
have the same lengths go through one kernel call together. No shuffle is needed beyond the pairing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelake.functions import rock, trace


def residual() -> Column:
    return F.col("obs") - F.col("syn")


def l1(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    return pairs.groupBy("shot").agg(F.sum(F.abs(residual() * dt)).alias("misfit"))


def l2(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    """The sum over traces of the root of each one's summed squares."""
    by_trace = pairs.groupBy("shot", "rcv").agg(F.sqrt(F.sum(residual() * residual() * dt)).alias("r"))
    return by_trace.groupBy("shot").agg(F.sum("r").alias("misfit"))


def smooth_l1(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    return pairs.groupBy("shot").agg((F.sum(smooth(residual())) * dt).alias("misfit"))


def smooth(d: Column) -> Column:
    return F.when(F.abs(d) < 1, d * d / 2).otherwise(F.abs(d) - 0.5)


def student_t(pairs: DataFrame, s: float = 1.0, sigma: float = 1.0, dt: float = 1.0) -> DataFrame:
    return pairs.groupBy("shot").agg(F.sum(0.5 * (s + 1) * F.log1p(residual() * residual() / (s * sigma * sigma)) * dt).alias("misfit"))


def panel(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    """L1, L2, smooth L1 and Student's t of each shot in one pass: partial sums by trace, one shuffle of those."""
    by_trace = pairs.groupBy("shot", "rcv").agg(F.sum(F.abs(residual())).alias("a"), F.sum(residual() * residual()).alias("q"), F.sum(smooth(residual())).alias("s"), F.sum(F.log1p(residual() * residual())).alias("t"))
    return by_trace.groupBy("shot").agg(*((F.sum(x) * dt).alias(n) for n, x in (("l1", "a"), ("smooth_l1", "s"), ("student_t", "t"))), F.sum(F.sqrt(F.col("q") * dt)).alias("l2"), F.count("*").alias("n_traces"))


def schedule(i: int, calls: int) -> float:
    """The weight of the second misfit, from 0 to 1 with the number of calls so far."""
    return 1 / (1 + float(np.exp(-(i - calls / 2))))


def weighted(first: DataFrame, second: DataFrame, i: int, calls: int = 1000) -> DataFrame:
    """w * first + (1 - w) * second, by shot."""
    w = schedule(i, calls)
    a, b = first.select("shot", F.col("misfit").alias("a")), second.select("shot", F.col("misfit").alias("b"))
    return a.join(b, "shot").select("shot", (w * F.col("a") + (1 - w) * F.col("b")).alias("misfit"))


def global_correlation(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    """Minus the mean product of traces of norm 1 over the root of their sample variances; dead traces count 0."""
    unit = pairs.select("shot", "rcv", trace.over_norm("obs").alias("a"), trace.over_norm("syn").alias("b"))
    by_trace = unit.groupBy("shot", "rcv").agg((-F.avg(F.col("a") * F.col("b")) / (F.sqrt(F.var_samp("a") * F.var_samp("b")) + 1e-8)).alias("c"))
    return by_trace.groupBy("shot").agg((F.sum(F.coalesce("c", F.lit(0.0))) * dt).alias("misfit"))


def integral(pairs: DataFrame, p: int = 2, kind: str = "square", theta: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Normalised integration: running sums of the transformed traces, each of sum 1; p = 1 is the Wasserstein-1 form."""
    least = None
    if kind == "linear":
        lowest = pairs.agg(F.least(F.min("obs"), F.min("syn")).alias("least_"), F.lit(1).alias("k_"))  # one row
        pairs, least = pairs.withColumn("k_", F.lit(1)).join(F.broadcast(lowest), "k_").drop("k_"), "least_"
    made = pairs.select("shot", "rcv", "it", *(rock.positive(c, kind, least, theta).alias(c) for c in ("obs", "syn")))
    made = made.select("shot", "rcv", "it", *(trace.over_sum(c).alias(c) for c in ("obs", "syn")))
    sums = made.select("shot", (trace.running_sum("obs") - trace.running_sum("syn")).alias("d"))
    return sums.groupBy("shot").agg(F.sum(F.pow(F.abs(F.col("d") * dt), F.lit(float(p)))).alias("misfit"))


# ---------------------------------------------------------------- kernels


#: Elements of the largest array that a kernel call makes for all its pairs.
ELEMENTS = 1 << 18
#: (pairs, samples) of the observed and of the synthetic traces -> a number for each pair.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def by_kernel(pairs: DataFrame, kernel: Kernel, name: str = "value", area: bool = False) -> DataFrame:
    """Array rows -> shot, rcv and the kernel's number for each trace. Pairs of the same lengths are stacked, as many as
    ELEMENTS allows for their samples (for their product, if the kernel works on an area). A null trace gives null, and
    so do empty ones."""

    def run(batches):
        for batch in batches:
            obs, syn = ([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(c)] for c in ("obs", "syn"))
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (o, s) in enumerate(zip(obs, syn, strict=True)):
                if o is not None and s is not None and len(o) and len(s):
                    groups.setdefault((len(o), len(s)), []).append(i)
            made: list[float | None] = [None] * batch.num_rows
            for (n, m), own in groups.items():
                step = max(1, ELEMENTS // (n * m if area else n + m))
                for part in (own[k : k + step] for k in range(0, len(own), step)):
                    for i, v in zip(part, kernel(np.stack([obs[i] for i in part]), np.stack([syn[i] for i in part])).tolist(), strict=True):
                        made[i] = v
            yield pa.RecordBatch.from_arrays([batch.column("shot"), batch.column("rcv"), pa.array(made, pa.float64())], ["shot", "rcv", name])

    wide = pairs.select(F.col("shot").cast("long"), F.col("rcv").cast("long"), *(F.col(c).cast("array<double>") for c in ("obs", "syn")))
    return wide.mapInArrow(run, f"shot bigint, rcv bigint, {name} double")


def summed(values: DataFrame, scale: float = 1.0) -> DataFrame:
    return values.groupBy("shot").agg((F.sum("value") * scale).alias("misfit"))


def lag_of(obs: np.ndarray, syn: np.ndarray) -> np.ndarray:
    """How much later each syn is: the lag of the largest absolute cross-correlation; ties go to the smallest lag."""
    n, m = obs.shape[1], syn.shape[1]
    size = 1 << (n + m - 2).bit_length()
    both = np.fft.irfft(np.fft.rfft(syn, size) * np.conj(np.fft.rfft(obs, size)), size)
    c = np.abs(np.concatenate([both[:, size - n + 1 :], both[:, :m]], axis=1))
    top = c.max(axis=1, keepdims=True)
    return np.where(top[:, 0] > 0, (c >= top - 1e-12).argmax(axis=1) - (n - 1.0), 0.0)


def travel_times(pairs: DataFrame) -> DataFrame:
    """shot, rcv, lag: the full cross-correlation, by FFT."""
    return by_kernel(pairs, lag_of, "lag")


def travel_time(pairs: DataFrame, dt: float = 1.0) -> DataFrame:
    return travel_times(pairs).groupBy("shot").agg(F.sum(F.pow(F.col("lag") * dt, F.lit(2.0)) / 2).alias("misfit"))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signals of rows by an FFT of odd length, so that no frequency is its own mirror."""
    size = 2 * x.shape[-1] - 1
    f = np.fft.fft(x, size)
    f[..., 1 : (size + 1) // 2] *= 2
    f[..., (size + 1) // 2 :] = 0
    return np.fft.ifft(f)[..., : x.shape[-1]]


def envelope(pairs: DataFrame, p: float = 1.5, norm: str = "L2", dt: float = 1.0, phase: bool = False) -> DataFrame:
    """Differences of the envelopes to the power p, or of the unwrapped phases."""

    def kernel(o: np.ndarray, s: np.ndarray) -> np.ndarray:
        a, b = analytic(o), analytic(s)
        d = np.unwrap(np.angle(b)) - np.unwrap(np.angle(a)) if phase else np.abs(b) ** p - np.abs(a) ** p
        return np.abs(d).sum(axis=1) if norm == "L1" else 0.5 * (d * d).sum(axis=1) * dt

    return summed(by_kernel(pairs, kernel))


def soft_dtw_value(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Soft dynamic time warping of rows with squared costs, one anti-diagonal of all rows at a time."""
    rows, n, m = len(x), x.shape[1], y.shape[1]
    before, last = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)
    before[:, 0] = 0.0
    for k in range(2, n + m + 1):
        now = np.full((rows, n + 1), np.inf)
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        three = np.stack([before[:, i - 1], last[:, i - 1], last[:, i]])
        low = three.min(axis=0)
        with np.errstate(invalid="ignore"):
            soft = low - gamma * np.log(np.exp(-(three - low) / gamma).sum(axis=0))
        now[:, i] = (x[:, i - 1] - y[:, k - i - 1]) ** 2 + np.where(np.isinf(low), np.inf, soft)
        before, last = last, now
    return last[:, n]


def soft_dtw(pairs: DataFrame, gamma: float = 1.0, every: int = 1, dt: float = 1.0) -> DataFrame:
    """The divergence d(x, y) - (d(x, x) + d(y, y)) / 2 of decimated traces."""

    def kernel(o: np.ndarray, s: np.ndarray) -> np.ndarray:
        o, s = o[:, ::every], s[:, ::every]
        return soft_dtw_value(o, s, gamma) - (soft_dtw_value(o, o, gamma) + soft_dtw_value(s, s, gamma)) / 2

    return summed(by_kernel(pairs, kernel), dt)


#: Rounds at most, and the change of potentials, over the regularisation, at which they end (the cost's error is about its square).
MOST_ROUNDS, STILL = 100_000, 1e-4


def sinkhorn_cost(x: np.ndarray, y: np.ndarray, p: int, blur: float, scaling: float) -> np.ndarray:
    """Entropic transport between equally weighted points (pairs, points, coordinates) in the log domain. The regularisation
    shrinks to blur ** p; there, rounds go on until potentials change by less than STILL. Pairs that are done leave the others."""
    cost = (np.abs(x[:, :, None] - y[:, None]) ** 2).sum(-1) ** (p / 2) / p
    a, b, least = -np.log(x.shape[1]), -np.log(y.shape[1]), blur**p
    f, g = np.zeros(x.shape[:2]), np.zeros(y.shape[:2])
    eps = np.maximum(np.ptp(np.concatenate([x, y], axis=1), axis=1).max(axis=1) ** p, least)
    left = np.arange(len(x))

    def soft_min(values: np.ndarray, e: np.ndarray) -> np.ndarray:
        top = values.max(axis=2, keepdims=True)
        return -e[:, 0] * (top[:, :, 0] + np.log(np.exp(values - top).sum(axis=2)))

    for _ in range(MOST_ROUNDS):
        e, c = eps[left][:, None, None], cost[left]
        f_new, g_new = soft_min(b + (g[left][:, None] - c) / e, e), soft_min(a + (f[left][:, None] - c.swapaxes(1, 2)) / e, e)
        moved = np.maximum(np.abs(f_new - f[left]).max(axis=1), np.abs(g_new - g[left]).max(axis=1))
        f[left], g[left] = (f[left] + f_new) / 2, (g[left] + g_new) / 2
        done = (eps[left] <= least) & (moved <= STILL * max(1.0, least))
        eps[left] = np.maximum(eps[left] * scaling**p, least)
        left = left[~done]
        if not len(left):
            return f.mean(axis=1) + g.mean(axis=1)
    raise RuntimeError(f"the potentials of {len(left)} pairs still change after {MOST_ROUNDS} rounds")


def sinkhorn(pairs: DataFrame, p: int = 2, blur: float = 1.0, scaling: float = 0.5, every: int = 1, dt: float = 1.0) -> DataFrame:
    """The debiased divergence of the traces as (time, amplitude) points, squared, times dt."""

    def kernel(o: np.ndarray, s: np.ndarray) -> np.ndarray:
        points = lambda v: np.stack([np.broadcast_to(np.arange(v.shape[1], dtype=float)[::every] * dt, v[:, ::every].shape), v[:, ::every]], 2)
        x, y = points(o), points(s)
        gap = sinkhorn_cost(x, y, p, blur, scaling) - (sinkhorn_cost(x, x, p, blur, scaling) + sinkhorn_cost(y, y, p, blur, scaling)) / 2
        return gap * gap * dt

    return summed(by_kernel(pairs, kernel, area=True))


def wasserstein_of(a: np.ndarray, b: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    """Between rows of distributions on the same points t: the quantile functions' difference to the power p, integrated.
    Both running sums are sorted together; how many of each lie before a place are the quantiles there."""
    n = len(t)
    sums = np.concatenate([np.cumsum(x / x.sum(axis=1, keepdims=True), axis=1) for x in (a, b)], axis=1)
    order = np.argsort(sums, axis=1, kind="stable")
    q, first = np.take_along_axis(sums, order, 1), order < n
    at = lambda own: t[np.minimum(np.cumsum(own, axis=1) - own, n - 1)]
    return (np.diff(q, prepend=0.0, axis=1) * np.abs(at(first) - at(~first)) ** p).sum(axis=1)


def wasserstein(pairs: DataFrame, p: int = 2, kind: str = "square", dt: float = 1.0) -> DataFrame:
    """One-dimensional Wasserstein distance between transformed traces of a length on their times."""
    shape = {"square": np.square, "abs": np.abs, "exp": np.exp, "softplus": lambda x: np.log1p(np.exp(x))}[kind]
    return summed(by_kernel(pairs, lambda o, s: wasserstein_of(shape(o) + 1e-18, shape(s) + 1e-18, np.arange(o.shape[1]) * dt, p)))


def adjoint_travel_time(pairs: DataFrame, lags: DataFrame) -> DataFrame:
    """shot, rcv, it, adjoint: the synthetic's centred difference over the sum of its squares, times the lag."""
    slope = pairs.select("shot", "rcv", "it", trace.centred_difference("syn").alias("d"))
    power = F.sum(F.col("d") * F.col("d")).over(trace.whole())
    made = slope.select("shot", "rcv", "it", (F.col("d") / F.when(power == 0, 1.0).otherwise(power)).alias("g"))
    return made.join(lags, ["shot", "rcv"]).select("shot", "rcv", "it", (F.col("g") * F.col("lag")).alias("adjoint"))


#: Misfits by name; more can be added: each takes pairs and its own parameters, and gives (shot, misfit).
SAMPLE_MISFITS: dict[str, Callable[..., DataFrame]] = {"l1": l1, "l2": l2, "smooth_l1": smooth_l1, "student_t": student_t, "global_correlation": global_correlation, "integral": integral}
TRACE_MISFITS: dict[str, Callable[..., DataFrame]] = {"travel_time": travel_time, "envelope": envelope, "soft_dtw": soft_dtw, "sinkhorn": sinkhorn, "wasserstein": wasserstein}
