"""Short-time Fourier transforms of traces: framed arrays, one transform for a batch; back by overlap-add.

A trace is given half a frame of zeros at both ends and so many more at the end that whole frames fit; frames overlap by
half and are weighed with a Gaussian of a sixth of their length. Spectra are divided by the sum of the window's weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of frames that are transformed at a time.
BLOCK = 1 << 20


def window(nperseg: int) -> np.ndarray:
    """A periodic Gaussian of deviation nperseg / 6."""
    if nperseg < 2 or nperseg % 2:
        raise ValueError(f"frames need an even number of samples: {nperseg}")
    return np.exp(-0.5 * ((np.arange(nperseg) - nperseg / 2) / (nperseg / 6)) ** 2)


def frames_of(length: int, nperseg: int) -> int:
    """How many frames a trace of so many samples has."""
    return 1 + math.ceil(length / (nperseg // 2)) if length else 0


def framed(x: np.ndarray, nperseg: int) -> np.ndarray:
    """(traces, samples) -> (traces, frames, samples of a frame), weighed."""
    hop, n = nperseg // 2, frames_of(x.shape[1], nperseg)
    padded = np.zeros((len(x), (n + 1) * hop))
    padded[:, hop : hop + x.shape[1]] = x
    return np.lib.stride_tricks.sliding_window_view(padded, nperseg, axis=1)[:, ::hop] * window(nperseg)


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    return [x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else None for x in column]


def by_length(rows: list[np.ndarray | None], most: int) -> list[list[int]]:
    """The rows that are there, grouped by length, in groups of about `most` samples."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        if x is not None and len(x):
            groups.setdefault(len(x), []).append(i)
    return [own[k : k + max(1, most // n)] for n, own in groups.items() for k in range(0, len(own), max(1, most // n))]


def spectra(traces: DataFrame, nperseg: int, column: str = "amp") -> DataFrame:
    """The other columns, frame, re and im (arrays over the frequencies 0 to nperseg / 2): a row for each frame of each trace.
    Null and empty traces have no frames."""
    others, scale = [c for c in traces.columns if c != column], 1 / window(nperseg).sum()

    def run(batches):
        for batch in batches:
            rows = vectors(batch.column(column))
            for own in by_length(rows, BLOCK):
                made = np.fft.rfft(framed(np.stack([rows[i] for i in own]), nperseg), axis=2) * scale
                n, width = made.shape[1], made.shape[2]
                at = pa.array(np.repeat(own, n))
                lists = [pa.ListArray.from_arrays(np.arange(0, len(own) * n * width + 1, width, dtype=np.int32), pa.array(part.ravel())) for part in (made.real, made.imag)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in others), pa.array(np.tile(np.arange(n), len(own))), *lists], [*others, "frame", "re", "im"])

    wide = traces.select(*others, F.col(column).cast("array<double>").alias(column))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema if f.name != column)
    return wide.mapInArrow(run, f"{fields}, frame bigint, re array<double>, im array<double>")


def restored(frames: DataFrame, nperseg: int, length: str, keys: list[str]) -> DataFrame:
    """(keys, the column `length`, frame, re, im) -> keys, amp: traces from their spectra, changed or not. Frames overlap
    and are added, over the sum of the squared windows; a frame that is missing counts as zeros."""
    w, hop = window(nperseg), nperseg // 2

    def run(table: pa.Table) -> pa.Table:
        n = table.column(length)[0].as_py()
        at = table.column("frame").to_numpy()
        spectrum = np.array(table.column("re").to_pylist(), float) + 1j * np.array(table.column("im").to_pylist(), float)
        parts = np.fft.irfft(spectrum * w.sum(), nperseg, axis=1) * w
        total = np.zeros(((frames_of(n, nperseg) + 1) * hop, 2))
        place = (at[:, None] * hop + np.arange(nperseg)).ravel()
        np.add.at(total[:, 0], place, parts.ravel())
        weights = np.zeros(len(total))
        for k in range(frames_of(n, nperseg)):
            weights[k * hop : k * hop + nperseg] += w * w
        amp = (total[:, 0] / weights)[hop : hop + n]
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "amp": pa.array([amp], pa.list_(pa.float64()))})

    fields = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, length, "frame", "re", "im").groupBy(*keys).applyInArrow(run, f"{fields}, amp array<double>")


def phase_correlation(pairs: DataFrame, nperseg: int) -> DataFrame:
    """shot, misfit: minus the sum, over traces, frames and frequencies, of both amplitudes times the cosine of the phases'
    difference. That is the real part of a product of spectra, and its sum over frequencies is one over samples and two of
    frequencies (Parseval), so nothing is transformed. Traces of a pair that differ in length, or are null, don't count."""
    scale = 1 / window(nperseg).sum() ** 2
    sign = (-1.0) ** np.arange(nperseg)

    def run(batches):
        for batch in batches:
            obs, syn = vectors(batch.column("obs")), vectors(batch.column("syn"))
            both = [x if x is not None and y is not None and len(x) == len(y) else None for x, y in zip(obs, syn, strict=True)]
            made: list[float | None] = [0.0 if x is not None else None for x in both]
            for own in by_length(both, BLOCK):
                d, u = (framed(np.stack([v[i] for i in own]), nperseg) for v in (both, syn))
                whole = nperseg * (d * u).sum(axis=(1, 2)) + (d.sum(axis=2) * u.sum(axis=2)).sum(axis=1) + ((d @ sign) * (u @ sign)).sum(axis=1)
                for i, v in zip(own, whole.tolist(), strict=True):
                    made[i] = -0.5 * scale * v
            yield pa.RecordBatch.from_arrays([batch.column("shot"), pa.array(made, pa.float64())], ["shot", "misfit"])

    wide = pairs.select("shot", *(F.col(c).cast("array<double>").alias(c) for c in ("obs", "syn")))
    return wide.mapInArrow(run, "shot bigint, misfit double").groupBy("shot").agg(F.coalesce(F.sum("misfit"), F.lit(0.0)).alias("misfit"))
