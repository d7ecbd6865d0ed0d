"""Normalized Indel similarity, 2 * LCS / (len + len)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine-word-parallel row per letter of ``b``."""
    seen = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & seen.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    if not total:
        return 1.0
    distance = total - 2 * lcs_length(a, b)
    return (1 - distance / total) * 100 / 100.0


def lcs_bound(a: str, b: str) -> int:
    """Letters in common regardless of order: never less than the LCS."""
    counts = {}
    for c in a:
        counts[c] = counts.get(c, 0) + 1
    common = 0
    for c in b:
        if counts.get(c, 0):
            counts[c] -= 1
            common += 1
    return common


def _lcs_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """:func:`lcs_length` of many pairs, a letter of all of them at a time; of at most 64 letters each."""
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    codes = lambda texts: np.array(texts, dtype="U64").view(np.uint32).reshape(len(texts), 64)
    a, b = codes(xs), codes(ys)
    there = np.arange(64) < n[:, None]
    bits = lambda flags: np.packbits(flags, axis=1, bitorder="little").view("<u8")[:, 0]
    row = full = bits(there)
    for k in range(m.max()):
        match = row & np.where(k < m, bits((a == b[:, k : k + 1]) & there), np.uint64(0))
        row = ((row + match) | (row - match)) & full
    return n - np.bitwise_count(row)


def indels(xs: list[str], ys: list[str]) -> np.ndarray:
    """:func:`indel` of many pairs."""
    out = np.empty(len(xs))
    narrow = np.array([0 < len(x) <= 64 and 0 < len(y) <= 64 for x, y in zip(xs, ys)], dtype=bool)
    for k in np.flatnonzero(~narrow):
        out[k] = indel(xs[k], ys[k])
    at = np.flatnonzero(narrow)
    if len(at):
        x, y = [xs[k] for k in at], [ys[k] for k in at]
        total = np.array([len(a) + len(b) for a, b in zip(x, y)])
        out[at] = (1 - (total - 2 * _lcs_lengths(x, y)) / total) * 100 / 100.0
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = indels(list(a[known]), list(b[known]))
    return pd.Series(out).astype(object).where(known, None)


@F.pandas_udf(T.BooleanType())
def indel_at_least(a: pd.Series, b: pd.Series, threshold: pd.Series) -> pd.Series:
    """Is the similarity at least ``threshold``?"""
    return pd.Series(indels(list(a), list(b)) >= threshold.to_numpy())
