"""Demand against money already sanctioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.rounding import portable_round
from ..operators.catchment import latest_school_rows, school_deficit, works_by_place
from ..operators.lookup import latest_by
from ..operators.spatial import radius_join

C = F.col


def _point_counts(reports: DataFrame, category: str) -> DataFrame:
    """Reports of a category per distinct point: crowded points are counted before any join."""
    return reports.filter((C("issue_category") == category) & C("lat").isNotNull() & C("lon").isNotNull()).groupBy(
        "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def reports_near(places: DataFrame, reports: DataFrame, category: str, key: str,
                 cfg: Settings = DEFAULTS) -> DataFrame:
    """Reports within the demand radius of each place (key, p_lat, p_lon): key, nearby_reports. Places of one point are counted once."""
    spots = places.select("p_lat", "p_lon").distinct()
    near = radius_join(_point_counts(reports, category), spots, cfg.demand_radius_km).groupBy("p_lat", "p_lon").agg(
        F.sum("n").alias("n"))
    return places.select(key, "p_lat", "p_lon").join(near, ["p_lat", "p_lon"]).groupBy(key).agg(
        F.sum("n").alias("nearby_reports"))


def reports_per_school(reports: DataFrame, schools: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Reports that name the school or lie within reach, each once: facility_id, nearby_reports.

    Named reports inside the radius are already in the radius count, so only named reports outside it are added.
    """
    from ..functions.geo import haversine_km

    s = schools.select(C("id").alias("facility_id"), "p_lat", "p_lon")
    near = reports_near(s, reports, "education", "facility_id", cfg)
    named = reports.filter("issue_category = 'education' and facility_id is not null and lat is not null"
                           " and lon is not null").groupBy("facility_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    far = named.join(s, "facility_id").filter(
        haversine_km(C("p_lat"), C("p_lon"), C("lat"), C("lon")) > cfg.demand_radius_km)
    both = near.unionByName(far.groupBy("facility_id").agg(F.sum("n").alias("nearby_reports")))
    return both.groupBy("facility_id").agg(F.sum("nearby_reports").alias("nearby_reports"))


def unspent_rupees() -> Column:
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("untied_receipts", "untied_payments", "tied_receipts", "tied_payments")]
    return portable_round(parts[0] - parts[1] + parts[2] - parts[3], 2)


def unspent_by_place(finance: DataFrame) -> DataFrame:
    """Money received and not spent in the latest year of a place; no record gives no row."""
    last = latest_by(finance.filter("place_id is not null"), ["place_id"], ["fin_year", "id"])
    return last.select("place_id", unspent_rupees().alias("unspent_rupees"), "fin_year")


def mismatch_class(demand: Column, funded: Column, any_record: Column) -> Column:
    return (
        F.when(demand & funded, "funded_undelivered").when(demand & ~any_record, "demanded_unfunded")
        .when(~demand & funded, "funded_not_demanded").otherwise("no_mismatch"))


CLASSES = ("funded_undelivered", "demanded_unfunded", "funded_not_demanded", "no_mismatch")


def village_investment(places: DataFrame, reports: DataFrame, works: DataFrame, finance: DataFrame,
                       cfg: Settings = DEFAULTS) -> DataFrame:
    """Villages with road demand or works: both sides and the class of their mismatch."""
    p = places.select(C("id").alias("place_id"), C("name").alias("village"), "district", C("lat").alias("p_lat"),
                      C("lon").alias("p_lon")).filter("p_lat is not null and p_lon is not null")
    t = (
        p.join(reports_near(p, reports, "road", "place_id", cfg), "place_id", "left")
        .join(works_by_place(works, cfg), "place_id", "left").join(unspent_by_place(finance), "place_id", "left")
        .na.fill(0, ["nearby_reports", "works", "undelivered_works"]).na.fill(0.0, ["undelivered_cost"]))
    t = t.filter("works > 0 or nearby_reports > 0")
    demand, funded = C("nearby_reports") > cfg.low_demand, C("undelivered_works") > 0
    return t.withColumn("mismatch", mismatch_class(demand, funded, C("works") > 0))


def unpinned_works(works: DataFrame) -> DataFrame:
    return works.agg(F.count_if(C("place_id").isNull()).alias("unpinned_works"))


def school_investment(facilities: DataFrame, reports: DataFrame, school_rows: DataFrame,
                      cfg: Settings = DEFAULTS) -> DataFrame:
    """Schools with demand or a condition row. Funded means unspent grant beside a recorded shortfall."""
    schools = facilities.filter("category = 'education' and p_lat is not null and p_lon is not null")
    row = latest_school_rows(school_rows).select(
        "facility_id", "total_grant", "total_expenditure", school_deficit().alias("infra_deficit"),
        F.lit(True).alias("_row"))
    t = (
        schools.select(C("id").alias("facility_id"), "name", "village", "district", "p_lat", "p_lon")
        .join(reports_per_school(reports, schools, cfg), "facility_id", "left").join(row, "facility_id", "left")
        .na.fill(0, ["nearby_reports"]).filter("nearby_reports > 0 or _row").drop("_row"))
    t = t.withColumn("unspent_rupees", portable_round(C("total_grant") - C("total_expenditure"), 2))
    funded = F.coalesce((C("unspent_rupees") > 0) & (C("infra_deficit") > 0), F.lit(False))
    return t.withColumn("mismatch", mismatch_class(C("nearby_reports") > cfg.low_demand, funded, funded))


def class_counts(rows: DataFrame) -> DataFrame:
    """Rows per mismatch class; classes without rows count zero."""
    names = rows.sparkSession.createDataFrame([(c,) for c in CLASSES], "mismatch string")
    n = rows.groupBy("mismatch").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "mismatch", "left").na.fill(0, ["n"])


def top_per_class(rows: DataFrame, order: list[Column], n: int = 15) -> DataFrame:
    w = Window.partitionBy("mismatch").orderBy(*order)
    return rows.filter("mismatch <> 'no_mismatch'").withColumn("position", F.row_number().over(w)).filter(
        C("position") <= n)
