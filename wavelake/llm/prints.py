"""Shingles of texts, their fingerprints, and cutting rows into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every run of size words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), joined by a space, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words]))[: len(words) - size + 1].tolist()
    return [xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(hashes: list) -> np.ndarray:
    """For a row of hashes for each document: (documents, 1) of 64 bits, set if set in over half of them. Counted byte by byte."""
    n = np.array([len(x) for x in hashes])
    flat = np.concatenate([np.asarray(x, np.uint64) for x in hashes])
    row = np.repeat(np.arange(len(n)), n) * 256
    by_byte = flat.view(np.uint8).reshape(-1, 8)
    ones = np.hstack([np.bincount(row + by_byte[:, p], minlength=len(n) * 256).reshape(-1, 256) @ BYTE_BITS for p in range(8)])
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").copy().view(np.uint64)


def runs(sizes: list[int], most: int, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `rows` rows and about `most` in size."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)
