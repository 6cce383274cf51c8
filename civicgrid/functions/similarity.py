"""Weighted string similarity, 0 to 100, on pairs of names.

The score follows the published definition: the indel ratio 200 * LCS / (len a + len b), raised by token-sorted,
token-set and partial comparisons under fixed scales. Spark has no longest-common-subsequence function, so this is the
one scalar Pandas UDF; it runs on candidate pairs only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed scales of the published definition.
TOKEN_SCALE = 0.95
PARTIAL_SCALE = 0.90
LONG_PARTIAL_SCALE = 0.60


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(a, b) / total


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def _token_parts(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_set_ratio(a: str, b: str) -> float:
    common, only_a, only_b = _token_parts(a, b)
    if not a.split() or not b.split():
        return 0.0
    if common and (not only_a or not only_b):
        return 100.0
    shared = " ".join(common)
    left = " ".join(filter(None, [shared, " ".join(only_a)]))
    right = " ".join(filter(None, [shared, " ".join(only_b)]))
    best = ratio(left, right)
    if shared:
        best = max(best, ratio(shared, left), ratio(shared, right))
    return best


def partial_ratio(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0
    pieces = [long[max(0, i):i + n] for i in range(1 - n, len(long))]
    return max(ratio(short, p) for p in pieces)


def partial_token_ratio(a: str, b: str) -> float:
    common, only_a, only_b = _token_parts(a, b)
    if common:
        return 100.0
    sorted_pair = partial_ratio(_sorted_tokens(a), _sorted_tokens(b))
    return max(sorted_pair, partial_ratio(" ".join(only_a), " ".join(only_b)))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    span = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if span < 1.5:
        if a.split() == [a] and b.split() == [b]:
            return best  # single words: every other comparison is the plain one on a lower scale
        sort = ratio(_sorted_tokens(a), _sorted_tokens(b))
        return max(best, TOKEN_SCALE * max(sort, token_set_ratio(a, b)))
    scale = PARTIAL_SCALE if span <= 8.0 else LONG_PARTIAL_SCALE
    best = max(best, partial_ratio(a, b) * scale)
    return max(best, partial_token_ratio(a, b) * TOKEN_SCALE * scale)


def weighted_ratio_column(a: Column, b: Column) -> Column:
    """The weighted ratio as a column.

    Marked as not deterministic, though it is: a filter on the score must stay behind the shuffle that makes pairs distinct and deals
    them over the tasks, and the optimizer would move it in front.
    """

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(p or "", q or "") for p, q in zip(x, y)])

    return score.asNondeterministic()(a, b)
