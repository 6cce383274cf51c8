"""Lookups by key: latest record, text fallbacks, upserts and work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest ``order``. Combined on the map side: no window over a hot key."""
    rest = [c for c in df.columns if c not in key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(top).select(*key, "_row.*")


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    top = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(top).select(*key, "_row.*")


def modal(df: DataFrame, key: Sequence[str], value: str, order: str, name: str | None = None) -> DataFrame:
    """Most frequent non-empty value per key; the value seen first (smallest ``order``) wins ties."""
    name = name or value
    seen = df.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    counted = seen.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*key).agg(
        F.min_by(F.col(value), F.struct((-F.col("_n")).alias("n"), F.col("_first"))).alias(name))


def place_lookup(facts: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``place_id``: match on (district, block, village), then (district, village), then village.

    Keys are trimmed and lower-cased. On the full key the last place wins, on the shorter keys the first.
    Facts carry ``district``, ``block``, ``village``; places ``id``, ``name``, ``district``, ``block``.
    """
    p = places.select(
        F.col("id"), clean_key(F.col("district")).alias("_d"), clean_key(F.col("block")).alias("_b"),
        clean_key(F.col("name")).alias("_v"))
    full = p.filter("_d <> '' and _b <> '' and _v <> ''").groupBy("_d", "_b", "_v").agg(F.max("id").alias("_full"))
    by_district = p.filter("_d <> '' and _v <> ''").groupBy("_d", "_v").agg(F.min("id").alias("_dist"))
    by_name = p.filter("_v <> ''").groupBy("_v").agg(F.min("id").alias("_name"))
    # One row per distinct spelling goes through the three lookups; facts join back once.
    keys = facts.select(
        clean_key(F.col("district")).alias("_d"), clean_key(F.col("block")).alias("_b"),
        clean_key(F.col("village")).alias("_v")).distinct()
    found = (
        keys.join(full, ["_d", "_b", "_v"], "left")
        .join(by_district, ["_d", "_v"], "left")
        .join(by_name, ["_v"], "left")
        .select("_d", "_b", "_v", F.coalesce("_full", "_dist", "_name").alias("place_id"))
    )
    return (
        facts.drop("place_id")
        .withColumns({"_d": clean_key(F.col("district")), "_b": clean_key(F.col("block")),
                      "_v": clean_key(F.col("village"))})
        .join(found, ["_d", "_b", "_v"], "left").drop("_d", "_b", "_v")
    )


def backfill_point(facts: DataFrame, places: DataFrame) -> DataFrame:
    """Fill missing ``latitude``/``longitude`` from the place of the same district and name, then of the same name."""
    p = places.filter("lat is not null").select(
        "id", "lat", "lon", clean_key(F.col("district")).alias("_d"), clean_key(F.col("name")).alias("_v"))
    point = F.struct("lat", "lon")
    both = p.groupBy("_d", "_v").agg(F.min_by(point, "id").alias("_p1"))
    name = p.groupBy("_v").agg(F.min_by(point, "id").alias("_p2"))
    todo = facts.latitude.isNull() | facts.longitude.isNull()
    keyed = facts.withColumns({"_d": clean_key(F.col("district")), "_v": clean_key(F.col("village"))})
    out = keyed.join(both, ["_d", "_v"], "left").join(name, ["_v"], "left")
    fill = F.coalesce("_p1", "_p2")
    return out.withColumns({
        "latitude": F.when(todo, fill["lat"]).otherwise(F.col("latitude")),
        "longitude": F.when(todo, fill["lon"]).otherwise(F.col("longitude")),
        "backfilled": todo & fill.isNotNull(),
    }).drop("_d", "_v", "_p1", "_p2")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key; others are added."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, key, ["_batch"]).drop("_batch")


def insert_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    fresh = new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def replace_group(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All old rows of every key present in the new batch make way for the new rows."""
    kept = old.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def worklist(all_keys: DataFrame, done: DataFrame, key: Sequence[str], order: Sequence[Column],
             limit: int | None = None) -> DataFrame:
    todo = all_keys.join(done.select(*key), list(key), "left_anti").orderBy(*order)
    return todo if limit is None else todo.limit(limit)
