"""Times are TIMESTAMP_NTZ in UTC; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def as_of(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def utc_time(text: Column) -> Column:
    """ISO text to UTC; text without a zone is taken as UTC; unusable text is NULL."""
    t = F.trim(text)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    offset = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = sign * (
        F.coalesce(F.regexp_extract(t, r"[+-](\d{2}):?(\d{2})$", 1).try_cast("int"), F.lit(0)) * 60
        + F.coalesce(F.regexp_extract(t, r"[+-](\d{2}):?(\d{2})$", 2).try_cast("int"), F.lit(0))
    )
    bare = F.regexp_replace(F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    local = bare.try_cast("timestamp_ntz")
    shifted = F.timestamp_add("MINUTE", -minutes, local)
    return F.when(zoned & t.rlike(r"\d:\d"), shifted).otherwise(F.regexp_replace(t, "T", " ").try_cast("timestamp_ntz"))


def utc_instant(ts: Column) -> Column:
    """The same moment as TIMESTAMP, which watermarks need, whatever the session's zone."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def flexible_time(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text."""
    number = F.trim(value).try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    micros = F.floor(seconds * 1e6 + 0.5).cast("bigint")
    epoch = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(number.isNotNull(), epoch).otherwise(utc_time(value))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / 60e6


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / 3.6e9


def since_hours(ts: Column, now: Column, hours: float) -> Column:
    return ts >= F.timestamp_add("SECOND", F.lit(int(-hours * 3600)), now)


def active_at(start: Column, end: Column, now: Column) -> Column:
    return F.coalesce((start <= now) & (now <= end), F.lit(False))


def capture_age_flag(captured: Column, received: Column, live: Column, cfg: Settings = DEFAULTS) -> Column:
    age = minutes_between(captured, received)
    late = (age > cfg.capture_max_age_min) | (age < -10)
    return F.when(captured.isNull(), live).otherwise(late)


def infra_record_age(category: Column, source: Column, year_text: Column, oldest_sanction: Column,
                     current_year: Column, cfg: Settings = DEFAULTS) -> Column:
    """Age in years of the record behind an infrastructure deficit."""
    school_year = F.coalesce(
        F.nullif(F.regexp_extract(year_text, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int"),
        F.lit(cfg.tap_coverage_year))
    year = (
        F.when(source == "udise_2024_25_this_school", school_year)
        .when(source == "jal_jeevan_mission_current", cfg.tap_coverage_year)
        .when((category == "road") & oldest_sanction.isNotNull(), oldest_sanction)
        .otherwise(cfg.baseline_year)
    )
    return F.greatest(F.lit(0), current_year - year).cast("double")


def vulnerability_record_age(current_year: Column, cfg: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(0), current_year - cfg.baseline_year).cast("double")
