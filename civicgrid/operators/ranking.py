"""Orders over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import checkpoint

C = F.col


def sum_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all rows ahead in ``order`` (which must be total).

    Rows are range-partitioned by the order; sums run inside each range, and each range starts where the ranges before
    it end. Only one row per range meets in one place. The ranges are written down first, because they come from a
    sample.
    """
    ranged = checkpoint(
        df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = ranged.groupBy("_part").agg(F.sum("_v").alias("_s")).select(
        "_part", F.coalesce(F.sum("_s").over(ahead), zero).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inside), zero)).join(starts, "_part")
    return out.withColumn(name, C("_start") + C("_in")).drop("_v", "_part", "_in", "_start")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1, 2, 3 ... over the whole table."""
    return sum_before(df, order, F.lit(1), name).withColumn(name, C(name) + 1)


def rank_within(df: DataFrame, key: Sequence[str], order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """1, 2, 3 ... inside each key (NULLs are one key), and with ``total`` the number of rows of the key.

    Rows are range-partitioned by key and order, so a key that holds half of the table spreads over half of the tasks; each
    range of a key starts where the ranges of that key before it end. A key costs one row per range beyond its own rows.
    Rows that are equal in ``order`` are ranked in any order.
    """
    key = list(key)
    ranged = checkpoint(
        df.repartitionByRange(*[C(k).asc() for k in key], *order).withColumn("_part", F.spark_partition_id()))
    by_key = Window.partitionBy(*key)
    ahead = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        C("_part").alias("_at"), *[C(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.sum("_n").over(by_key).alias("_all"))
    same = C("_part") == C("_at")
    for i, k in enumerate(key):
        same = same & C(k).eqNullSafe(C(f"_k{i}"))
    inside = Window.partitionBy("_part", *key).orderBy(*order)
    out = ranged.withColumn("_in", F.row_number().over(inside)).join(starts, same)
    return out.select(*df.columns, (C("_start") + C("_in")).alias(name), *([C("_all").alias(total)] if total else []))


def with_next(df: DataFrame, rank: str, value: str, name: str) -> DataFrame:
    """``value`` of the row one rank further down."""
    after = df.select((C(rank) - 1).alias(rank), C(value).alias(name))
    return df.join(after, rank, "left")


def quantile(df: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """One row: the exact quantile, between two neighbours in proportion; NULL values do not count, none gives NULL."""
    known = df.select(value.cast("double").alias("_x")).filter("_x is not null")
    total = known.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    at = global_rank(known, [C("_x")], "_rank").withColumn("_one", F.lit(1)).join(total, "_one").withColumn(
        "_at", F.lit(share) * (C("_n") - 1))
    low = F.floor("_at")
    weight = F.when(C("_rank") - 1 == low, low + 1 - C("_at")).when(C("_rank") - 2 == low, C("_at") - low)
    return at.agg(F.sum(weight * C("_x")).alias(name))
