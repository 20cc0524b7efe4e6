"""Deterministic jitter, from a 64-bit FNV-1a hash in wrapping arithmetic that SQL does not offer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

#: FNV-1a, 64 bits.
OFFSET, PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def fnv1a(keys: pd.Series, numbers: np.ndarray) -> np.ndarray:
    """Hashes of each key's UTF-8 bytes followed by the number's eight bytes, highest first; all rows of one byte position at a time."""
    raw = [k.encode() for k in keys]
    size = np.array([len(r) for r in raw], np.int64)
    width = int(size.max()) if len(raw) else 0
    padded = np.zeros((len(raw), width), np.uint8)
    for i, r in enumerate(raw):
        padded[i, : len(r)] = np.frombuffer(r, np.uint8)
    h = np.full(len(raw), OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for p in range(width):
            h = np.where(p < size, (h ^ padded[:, p]) * PRIME, h)
        for shift in range(56, -1, -8):
            h = (h ^ ((numbers >> shift) & 255).astype(np.uint64)) * PRIME
    return h


@F.pandas_udf(T.LongType())
def jitter_ms(key: pd.Series, at: pd.Series, window_ms: pd.Series) -> pd.Series:
    """Milliseconds below the window, from the key and an instant in microseconds; null where either is."""
    there = (key.notna() & at.notna()).to_numpy()
    out = pd.Series([None] * len(key), dtype="Int64")
    if there.any():
        h = fnv1a(key[there], at[there].to_numpy().astype(np.int64) * 1000)
        w = window_ms[there].to_numpy().astype(np.uint64)
        out[there] = np.where(w > 0, h % np.maximum(w, np.uint64(1)), 0).astype(np.int64)
    return out
