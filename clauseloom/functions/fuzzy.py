"""String ratios that have no native form, as Arrow-batched pandas functions. Score distinct pairs only."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lcs(a: str, b: str) -> int:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if u := v & at.get(c, 0):
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (length of both); 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * _lcs(a, b) / n if n else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    windows = {b[max(0, i) : min(len(b), i + n)] for i in range(-n + 1, len(b))}
    return max(indel_ratio(a, w) for w in windows)


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of the ratios among the shared tokens and the shared with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(d))))) for d in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 1.0
    return max(indel_ratio(one, two), indel_ratio(both, one) if both else 0.0, indel_ratio(both, two) if both else 0.0)


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def blend(a: str, b: str) -> float:
    """0.2 ratio + 0.2 partial + 0.3 token sort + 0.3 token set; 0 if one is empty."""
    if not a or not b:
        return 0.0
    return 0.2 * indel_ratio(a, b) + 0.2 * partial_ratio(a, b) + 0.3 * token_sort_ratio(a, b) + 0.3 * token_set_ratio(a, b)


def _column(ratio):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


#: M10, M11, M06, M32 and M08; null if either side is null.
sequence = _column(sequence_ratio)
ratio = _column(indel_ratio)
token_sort = _column(token_sort_ratio)
token_set = _column(token_set_ratio)
fuzzy_blend = _column(blend)
