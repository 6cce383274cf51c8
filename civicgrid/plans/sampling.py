"""Weighted picks that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import sum_before
from ..operators.state import checkpoint

C = F.col


def weighted_pick(draws: DataFrame, items: DataFrame, default_weight: float = 50.0) -> DataFrame:
    """One item per draw, with replacement, with chance by weight: draw_id, item_id.

    ``draws``: draw_id, u in [0, 1). ``items``: item_id, weight (NULL or 0 takes the default). The weights become
    consecutive ranges of 0..1. Starts of ranges and draws are range-partitioned together, and a draw takes the last start
    at or before it; of every partition only its last start is carried over to the next.
    """
    w = F.when(C("weight") > 0, C("weight").cast("double")).otherwise(default_weight)
    t = items.select("item_id", w.alias("w"))
    total = t.agg(F.sum("w").alias("_total")).withColumn("_one", F.lit(1))
    r = sum_before(t, [C("item_id")], C("w"), "_lo").withColumn("_one", F.lit(1)).join(total, "_one")
    starts = r.select((C("_lo") / C("_total")).alias("at"), F.lit(None).cast(dict(draws.dtypes)["draw_id"]).alias("draw_id"), "item_id")
    asks = draws.select(C("u").alias("at"), "draw_id", F.lit(None).cast(dict(items.dtypes)["item_id"]).alias("item_id"))
    order = [C("at"), C("item_id").isNull(), C("item_id"), C("draw_id")]
    line = checkpoint(starts.unionByName(asks).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = line.filter("item_id is not null").groupBy("_part").agg(F.max(F.struct("at", "item_id")).alias("_m"))
    parts = line.select("_part").distinct().join(last, "_part", "left").select(
        "_part", F.last("_m.item_id", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = line.withColumn("_own", F.last("item_id", ignorenulls=True).over(inside)).filter("draw_id is not null")
    return own.join(parts, "_part").select("draw_id", F.coalesce("_own", "_carried").alias("item_id")).filter(
        "item_id is not null")
