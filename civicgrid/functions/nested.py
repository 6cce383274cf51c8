"""Arrays, maps and JSON at the edges of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(text: Column, path: str, default: float | None = None) -> Column:
    """A number at a JSON path; broken JSON or a missing path gives the default."""
    got = F.get_json_object(text, path).try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def count_map(key: Column, n: Column) -> Column:
    """Aggregate: map of key to count from already counted rows, NULL keys left out."""
    entries = F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("key"), n.alias("value"))))
    return F.map_from_entries(F.array_sort(entries))


def map_text(m: Column) -> Column:
    """``k=v`` pairs in key order, for display and comparison."""
    parts = F.transform(
        F.array_sort(F.map_entries(m)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(parts, ",")


def ordered_children(order: Column, child: Column) -> Column:
    """Aggregate: child structs of one parent in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), child.alias("c"))))
    return F.transform(rows, lambda r: r["c"])


def flag_union(flags: Column) -> Column:
    """Aggregate over a flags array: sorted distinct flags of the group, from exploded partial sets."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags))))


def polyline_from_text(text: Column) -> Column:
    """``[[lat, lon], ...]`` text to ``array<struct<lat,lon>>``; broken text gives an empty array."""
    raw = F.from_json(text, "array<array<double>>")
    pairs = F.transform(raw, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))
    return F.coalesce(pairs, F.array().cast("array<struct<lat:double,lon:double>>"))
