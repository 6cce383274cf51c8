"""Emergency wording of one report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs as a substring of the (already lower-cased) text."""
    found = [F.contains(text, F.lit(w)) for w in sorted({w.lower() for w in words})]
    return reduce(or_, found)


def emergency_label(text: Column, category: Column) -> Column:
    """collapse, partial, crack or NULL; bridges and buildings only, and on roads bridges only."""
    t = F.lower(F.coalesce(text, F.lit("")))
    bridge = contains_any(t, vocab.BRIDGE)
    building = contains_any(t, vocab.BUILDING) | F.coalesce(category.isin("education", "health"), F.lit(False))
    road_only = F.coalesce(category == "road", F.lit(False)) & ~bridge
    return F.when((bridge | building) & ~road_only & (t != ""), (
        F.when(contains_any(t, vocab.COLLAPSE), "collapse").when(contains_any(t, vocab.PARTIAL), "partial")
        .when(contains_any(t, vocab.CRACK), "crack")))
