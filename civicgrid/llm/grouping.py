"""Groups of similar items from buckets of candidates, without comparing a crowded bucket with itself.

Two passes, together exact on the candidates:
1. every member is compared with its bucket's hub only, the member that shares most places with others, which joins a
   group of copies around their original by one comparison per copy;
2. members of buckets that still hold several components go to a second, narrower search for pairs across components.
A pair left out shares a component already, so it cannot change the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.state import checkpoint

C = F.col


def with_hubs(filed: DataFrame) -> DataFrame:
    """``bucket``, ``id``, ``hub`` from (bucket, id): buckets of one member are left out.

    The hub is the member whose buckets are largest in sum.
    """
    sizes = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = checkpoint(filed.join(sizes, "bucket"))
    weight = shared.groupBy("id").agg(F.sum("k").alias("w"))
    hubs = shared.join(weight, "id").groupBy("bucket").agg(
        F.max(F.struct("w", F.xxhash64("id").alias("h"), "id")).alias("m"))
    return shared.select("bucket", "id").join(hubs.select("bucket", C("m.id").alias("hub")), "bucket")


def grouped(nodes: DataFrame, entries: DataFrame, confirm: Callable[[DataFrame], DataFrame],
            across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node``, ``root`` (the smallest node of its group).

    ``nodes``: ``node``. ``entries``: ``bucket``, ``id``, ``hub``, one row per bucket and member. ``confirm`` keeps the truly
    similar pairs of (src, dst). ``across`` makes, of the rows (bucket, id, root) of the buckets that hold several roots,
    the pairs (src, dst) that may still be similar.
    """
    ends = [F.least("id", "hub").alias("src"), F.greatest("id", "hub").alias("dst")]
    stars = checkpoint(entries.filter("id <> hub").select(*ends).distinct())
    near = checkpoint(confirm(stars))
    roots = components(nodes, near)
    placed = entries.select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id")
    split = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    alive = checkpoint(placed.join(split.select("bucket"), "bucket", "left_semi"))
    rest = across(alive).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    late = checkpoint(confirm(checkpoint(rest.join(stars, ["src", "dst"], "left_anti"))))
    if late.isEmpty():
        return roots
    # the groups so far are the nodes of the second pass
    top = roots.select(C("root").alias("node")).distinct()
    ends = roots.select(C("node").alias("src"), C("root").alias("a")), roots.select(C("node").alias("dst"), C("root").alias("b"))
    bridges = late.join(ends[0], "src").join(ends[1], "dst").select(C("a").alias("src"), C("b").alias("dst")).distinct()
    joined = components(top, bridges).select(C("node").alias("root"), C("root").alias("last"))
    return checkpoint(roots.join(joined, "root").select("node", C("last").alias("root")))
