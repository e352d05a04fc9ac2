"""Filters in the frequency domain: traces of a batch are stacked and go through one FFT."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: zeros that follow a trace before it is transformed.
PADDING = 512


def butterworth_gain(n: int, highcut: float, rate: float, order: int) -> np.ndarray:
    """The squared gain of a digital Butterworth low-pass (by the bilinear transform) at the frequencies of a real FFT of
    length n: what filtering forward and backward leaves, so there is no shift."""
    if not 0 < highcut < rate / 2:
        raise ValueError(f"highcut must lie between 0 and half the sampling rate: {highcut}, {rate}")
    warped = np.tan(np.minimum(np.arange(n // 2 + 1) / n, 0.5 - 1e-12) * math.pi) / math.tan(math.pi * highcut / rate)
    return 1 / (1 + warped ** (2.0 * order))


def low_pass(traces: DataFrame, highcut: float, rate: float, order: int = 3, columns: tuple[str, ...] = ("amp",), padding: int = PADDING) -> DataFrame:
    """The array columns without what oscillates faster than highcut (rate: samples a second); other columns stay.

    The filter is real and symmetric in frequency, so it is its own adjoint: residuals go back through it unchanged. Null
    arrays stay null, empty ones empty; traces may have different lengths.
    """

    def filtered(rows: list) -> list:
        out = list(rows)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            if x is not None and len(x):
                by_length.setdefault(len(x), []).append(i)
        for length, which in by_length.items():
            n = length + padding
            spectrum = np.fft.rfft(np.array([rows[i] for i in which], float), n, axis=1)
            made = np.fft.irfft(spectrum * butterworth_gain(n, highcut, rate, order), n, axis=1)[:, :length]
            for i, x in zip(which, made, strict=True):
                out[i] = x
        return out

    def run(batches):
        for batch in batches:
            made = {c: pa.array(filtered([x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(c)]), pa.list_(pa.float64())) for c in columns}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    wide = traces.withColumns({c: traces[c].cast("array<double>") for c in columns})
    return wide.mapInArrow(run, wide.schema)


low_pass_adjoint = low_pass
