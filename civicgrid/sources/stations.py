"""Water level telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def trend(current: Column, previous: Column) -> Column:
    """Levels are negative metres: more negative is a falling table."""
    step = current - previous
    return F.when(step < -0.05, "falling").when(step > 0.05, "rising").otherwise("stable")


def last_two(readings: DataFrame, station: str, order: list[str], value: str) -> DataFrame:
    """Latest usable reading of each station, the one before it and the trend. Zero means not calibrated.

    Only two readings per station leave each task, so a station with a long history is no hot group.
    """
    usable = readings.filter((C(value) != 0) & C(value).isNotNull())
    newest = usable.groupBy(station).agg(F.max(F.struct(*order, value)).alias("_last"))
    before = usable.join(newest, station).filter(F.struct(*order) < F.struct(*[C("_last." + o) for o in order])).groupBy(
        station).agg(F.max_by(value, F.struct(*order)).alias("previous"))
    return newest.join(before, station, "left").select(
        station, *[C("_last." + o).alias(o) for o in order], C("_last." + value).alias(value), "previous",
        trend(C("_last." + value), C("previous")).alias("trend"))
