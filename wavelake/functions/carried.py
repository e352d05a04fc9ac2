"""Operators along a trace that go on from a state: a chunk and the state before it give its values and the state after it.

Any cut of a trace into chunks gives the same values, up to rounding. Each kernel has `start` (the state before the first
sample) and is called with a chunk (array of doubles) and a state (list of doubles); empty chunks leave the state as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

State = list[float]
Kernel = Callable[[np.ndarray, State], tuple[np.ndarray, State]]


@dataclass(frozen=True)
class RunningSum:
    """The sum up to each sample, times the spacing."""

    spacing: float = 1.0
    start = (0.0,)

    def __call__(self, x: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        y = state[0] + np.cumsum(x) * self.spacing
        return y, [float(y[-1])] if len(y) else state


@dataclass(frozen=True)
class Unwrap:
    """Steps beyond pi brought within (-pi, pi], and what that takes carried on. State: the last phase (NaN before the
    first) and what was added up to it."""

    start = (math.nan, 0.0)

    def __call__(self, x: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        if not len(x):
            return x, state
        d = np.diff(x, prepend=x[0] if math.isnan(state[0]) else state[0])
        wrapped = (d + math.pi) - np.floor((d + math.pi) / (2 * math.pi)) * 2 * math.pi - math.pi
        wrapped[(wrapped == -math.pi) & (d > 0)] = math.pi
        fixed = state[1] + np.cumsum(np.where(np.abs(d) < math.pi, 0.0, wrapped - d))
        return x + fixed, [float(x[-1]), float(fixed[-1])]


@dataclass(frozen=True)
class LowPass:
    """A causal Butterworth low-pass of second order (bilinear transform), highcut at a rate of so many samples a second.

    As a state space s' = A s + B x, y = C s + D x, cut into blocks: a block's values are one product of a triangular matrix
    with its samples and one of a tall matrix with the state before it, so no sample is looked at alone.
    """

    highcut: float
    rate: float
    block: int = 64
    start = (0.0, 0.0)

    def __post_init__(self) -> None:
        if not 0 < self.highcut < self.rate / 2:
            raise ValueError(f"highcut must lie between 0 and half the sampling rate: {self.highcut}, {self.rate}")

    @property
    def coefficients(self) -> tuple[list[float], list[float]]:
        """b (of the samples) and a (of the values, a[0] = 1)."""
        k = math.tan(math.pi * self.highcut / self.rate)
        norm = 1 + math.sqrt(2) * k + k * k
        return [k * k / norm, 2 * k * k / norm, k * k / norm], [1.0, 2 * (k * k - 1) / norm, (1 - math.sqrt(2) * k + k * k) / norm]

    @cached_property
    def matrices(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """A block's response to its samples and to the state, the powers of A, and what each sample leaves in the state."""
        b, a = self.coefficients
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        powers = [np.eye(2)]
        for _ in range(self.block):
            powers.append(step @ powers[-1])
        response = np.array([b[0], *(powers[k][0] @ enter for k in range(self.block - 1))])
        lag = np.arange(self.block)[:, None] - np.arange(self.block)
        toeplitz = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        return toeplitz, np.array([p[0] for p in powers[: self.block]]), powers, np.array([powers[k] @ enter for k in range(self.block)])

    def __call__(self, x: np.ndarray, state: State) -> tuple[np.ndarray, State]:
        toeplitz, watch, powers, left = self.matrices
        s, out = np.array(state), np.empty(len(x))
        for at in range(0, len(x), self.block):
            own = x[at : at + self.block]
            n = len(own)
            out[at : at + n] = toeplitz[:n, :n] @ own + watch[:n] @ s
            s = powers[n] @ s + left[:n][::-1].T @ own
        return out, s.tolist()


def applied(traces: DataFrame, kernel: Kernel, column: str = "amp") -> DataFrame:
    """Whole traces (array rows) through the kernel, from its start; other columns stay. Null arrays stay null."""

    def run(batches):
        for batch in batches:
            made = [kernel(x.values.to_numpy(zero_copy_only=False).astype(float), list(kernel.start))[0] if x.is_valid else None for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())) if c == column else batch.column(c) for c in batch.schema.names], batch.schema.names)

    wide = traces.withColumn(column, traces[column].cast("array<double>"))
    return wide.mapInArrow(run, wide.schema)
