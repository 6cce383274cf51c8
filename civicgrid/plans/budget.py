"""Which costed assets a budget should pay for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.rounding import portable_round
from ..operators.state import salted, spread

C = F.col
OBJECTIVES = ("population", "priority")
BUCKETS = 32


def candidates(assets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Road and water assets with a known cost: undelivered works, or the unspent part of undelivered schemes.

    ``assets``: asset_id, asset_type, district, undelivered_cost_lakh, undelivered_schemes, unspent_estimate_lakh, people,
    priority_score.
    """
    cost = F.when(C("asset_type") == "road", C("undelivered_cost_lakh")).when(
        (C("asset_type") == "water") & (C("undelivered_schemes") > 0), C("unspent_estimate_lakh"))
    return assets.withColumn("cost_lakh", portable_round(cost, 2)).filter("cost_lakh > 0").select(
        "asset_id", "asset_type", "district", "cost_lakh", F.coalesce("people", F.lit(0)).alias("people"),
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), cost_units(C("cost_lakh"), cfg).alias("units"))


def cost_units(cost_lakh: Column, cfg: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(1), F.round(cost_lakh / F.lit(cfg.cost_step_lakh), 0).cast("int"))


def scenario_items(items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Candidates of every scenario that can be part of a best choice.

    ``scenarios``: scenario, district (NULL for all), budget_lakh, objective. A budget of B units holds at most B / c
    items of cost c, so only the most valuable B / c of each cost stay. That loses nothing and bounds a scenario by
    its budget (about B ln B items), however many candidates there are.
    """
    s = scenarios.withColumn("capacity", F.greatest(F.lit(0), F.floor(C("budget_lakh") + 0.5).cast("int")))
    # Every candidate meets every country-wide scenario; the buckets keep that join off a single task.
    everywhere = spread(s.filter("district is null").drop("district"), BUCKETS)
    whole = salted(items, C("asset_id"), BUCKETS).join(everywhere, "_salt").drop("_salt")
    local = items.join(s.filter("district is not null"), "district")
    both = whole.unionByName(local, allowMissingColumns=True).filter("units <= capacity")
    worth = F.when(C("objective") == "population", C("people").cast("double")).otherwise(C("priority_score"))
    both = both.withColumn("worth", worth).filter("worth > 0")
    limit = F.floor(C("capacity") / C("units"))
    order = [C("worth").desc(), C("asset_id")]
    # Many assets may share one cost: every bucket first keeps its own best, then the survivors meet.
    both = salted(both, C("asset_id"), BUCKETS)
    for group in (["scenario", "units", "_salt"], ["scenario", "units"]):
        w = Window.partitionBy(*group).orderBy(*order)
        both = both.withColumn("_rn", F.row_number().over(w)).filter(C("_rn") <= limit)
    return both.drop("_rn", "_salt")


def _settled(units: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Items that every best choice takes, and items that none takes.

    A greedy choice gives a value that can be reached. An item is settled when forcing it the other way bounds the value,
    by filling up with parts of items in order of value per unit, below that.
    """
    order = np.argsort(-worth / units, kind="stable")
    u, w = units[order].astype(float), worth[order]
    fill, value = np.concatenate(([0], np.cumsum(u))), np.concatenate(([0], np.cumsum(w)))
    reached, left = 0.0, float(capacity)
    for cost, gain in zip(u, w):
        if cost <= left:
            reached, left = reached + gain, left - cost

    def bound(room: np.ndarray) -> np.ndarray:
        """Value of the best items, the last in part, that fill ``room``."""
        at = np.minimum(np.searchsorted(fill, room, "right") - 1, len(u) - 1)
        return value[at] + np.minimum(1.0, (room - fill[at]) / u[at]) * w[at]

    slack = 1e-9 * max(1.0, reached)
    with_item = bound(np.maximum(0.0, capacity - u)) + w  # the item may count twice, which keeps it a bound
    without = bound(np.minimum(capacity + u, fill[-1])) - w
    never, always = np.zeros(len(u), bool), np.zeros(len(u), bool)
    never[order] = (with_item < reached - slack) | (u > capacity)
    always[order] = (without < reached - slack) & (u <= capacity)
    return always, never & ~always


def _taken(units: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Exact choice; the earlier item wins among equals. Keeps one row of values per block of items and works the blocks
    through again from the last one, so memory grows with the root of the items."""
    n = len(units)
    block = max(1, int(np.sqrt(n)))
    starts = list(range(0, n, block))
    best, rows = np.zeros(capacity + 1), []

    def add(best: np.ndarray, i: int) -> np.ndarray | None:
        cost = int(units[i])
        if cost > capacity:
            return None
        with_item = best[: capacity + 1 - cost] + worth[i]
        better = with_item > best[cost:]
        best[cost:] = np.where(better, with_item, best[cost:])
        return better

    for s in starts:
        rows.append(best.copy())
        for i in range(s, min(n, s + block)):
            add(best, i)
    chosen, left = np.zeros(n, bool), capacity
    for s, row in zip(reversed(starts), reversed(rows)):
        better = [add(row, i) for i in range(s, min(n, s + block))]
        for i in range(min(n, s + block) - 1, s - 1, -1):
            if better[i - s] is not None and left >= units[i] and better[i - s][left - int(units[i])]:
                chosen[i] = True
                left -= int(units[i])
    return chosen


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact 0/1 choice over whole units, of any size; the earlier asset wins among equals."""
    pdf = pdf.sort_values("asset_id", kind="stable").reset_index(drop=True)
    units, worth = pdf["units"].to_numpy(np.int64), pdf["worth"].to_numpy(float)
    capacity = int(pdf["capacity"].iloc[0])
    chosen, never = _settled(units, worth, capacity)
    core = np.flatnonzero(~chosen & ~never)
    chosen[core] = _taken(units[core], worth[core], capacity - int(units[chosen].sum()))
    return pdf.loc[chosen, ["scenario", "asset_id", "cost_lakh", "people", "priority_score", "units", "worth"]]


def allocate(items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Chosen assets of every scenario. Scenarios run beside each other; one scenario is one bounded group."""
    return scenario_items(items, scenarios).groupBy("scenario").applyInPandas(
        _choose, "scenario string, asset_id long, cost_lakh double, people long, priority_score double, units int,"
                 " worth double")


def totals(chosen: DataFrame, scenarios: DataFrame) -> DataFrame:
    sums = chosen.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_chosen"), portable_round(F.sum("cost_lakh"), 2).alias("total_cost_lakh"),
        F.sum("people").alias("population_reached"),
        portable_round(F.avg("priority_score"), 2).alias("priority_weighted_benefit"), F.sum("worth").alias("worth"))
    return (
        scenarios.join(sums, "scenario", "left").na.fill(0, ["n_chosen", "population_reached"])
        .na.fill(0.0, ["total_cost_lakh", "priority_weighted_benefit", "worth"])
        .withColumn("remaining_budget_lakh", portable_round(C("budget_lakh") - C("total_cost_lakh"), 2)))


def upper_bound(items: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Value no choice can beat: the best items by value per unit, the last one in part."""
    t = scenario_items(items, scenarios)
    w = Window.partitionBy("scenario").orderBy((C("worth") / C("units")).desc(), "asset_id")
    used = F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("_before", used - C("units"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (C("capacity") - C("_before")) / C("units")))
    return t.groupBy("scenario").agg(F.sum(part * C("worth")).alias("bound"))
