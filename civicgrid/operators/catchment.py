"""Facts of the villages around a centre. A centre has ``group_id``, ``category``, ``lat``, ``lon``.

Registers are first reduced to one row per place, so the distance join meets one row per village; every deficit is then
a column over one aggregation of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Settings
from ..functions.rounding import clamp01, portable_round
from .lookup import latest_by
from .ranking import quantile
from .spatial import radius_join

C = F.col


def catchment_radius(category: Column, cfg: Settings = DEFAULTS) -> Column:
    out = F.lit(cfg.default_catchment_km)
    for name, km in cfg.catchment_km.items():
        out = F.when(category == name, km).otherwise(out)
    return out


def villages_near(centres: DataFrame, villages: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Centre-village pairs within the catchment of the centre's category."""
    widest = max(*cfg.catchment_km.values(), cfg.default_catchment_km)
    return radius_join(
        centres.select("group_id", "category", "lat", "lon"), villages, widest,
        own_radius=catchment_radius(C("category"), cfg))


def catchment_population(centres: DataFrame, villages: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    near = villages_near(centres, villages.select("place_id", "population", "p_lat", "p_lon"), cfg)
    sums = near.groupBy("group_id").agg(F.sum("population").alias("people"), F.count(F.lit(1)).alias("villages"))
    return centres.select("group_id", "category").join(sums, "group_id", "left").select(
        "group_id", "category", F.coalesce("people", F.lit(0)).alias("people"),
        F.coalesce("villages", F.lit(0)).alias("villages"))


def village_index(places: DataFrame, amenities: DataFrame) -> DataFrame:
    """Places with coordinates, their amenities where recorded, and whether any are recorded."""
    p = places.filter("lat is not null and lon is not null").select(
        C("id").alias("place_id"), C("name").alias("place_name"), "district", "block", "population",
        C("lat").alias("p_lat"), C("lon").alias("p_lon"))
    a = amenities.withColumn("has_real_data", F.lit(True))
    return p.join(a, "place_id", "left").withColumn("has_real_data", F.coalesce("has_real_data", F.lit(False)))


# ---- registers, one row per place

def undelivered(status: Column, cfg: Settings = DEFAULTS) -> Column:
    return status.isin(*cfg.undelivered_statuses)


def works_by_place(works: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    open_work = F.coalesce(undelivered(C("status"), cfg), F.lit(False))
    return works.filter(C("place_id").isNotNull()).groupBy("place_id").agg(
        F.count(F.lit(1)).alias("works"),
        F.count_if(open_work).alias("undelivered_works"),
        F.coalesce(F.sum(F.when(open_work, F.coalesce("cost_lakh", F.lit(0.0)))), F.lit(0.0)).alias("undelivered_cost"),
        F.min(F.when(open_work, C("sanction_year"))).alias("oldest_year"))


def schemes_by_place(schemes: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    open_scheme = F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*cfg.undelivered_scheme_statuses)
    rest = F.greatest(
        F.lit(0.0), F.coalesce("estimated_lakh", F.lit(0.0)) - F.coalesce("spent_lakh", F.lit(0.0)))
    return schemes.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("schemes"), F.count_if(open_scheme).alias("undelivered_schemes"),
        F.coalesce(F.sum(F.when(open_scheme, rest)), F.lit(0.0)).alias("unspent_lakh"))


def tests_by_place(water_tests: DataFrame) -> DataFrame:
    """The last row of a place counts; earlier rows are replaced, not added."""
    last = latest_by(water_tests.filter("place_id is not null"), ["place_id"], ["id"])
    return last.select("place_id", F.coalesce("samples_tested", F.lit(0)).alias("samples"), F.lit(1).alias("tested"))


def employment_by_place(employment: DataFrame) -> DataFrame:
    last = latest_by(employment.filter("place_id is not null"), ["place_id"], ["fin_year", "id"])
    return last.select(
        "place_id", C("fin_year").alias("job_year"), F.lit(1).alias("job_record"),
        *[F.coalesce(c, F.lit(0.0)).alias("job_" + c) for c in ("total_lakh", "wages_lakh", "material_lakh")])


# ---- one aggregation per centre

def share(field: str, absent) -> Column:
    """Aggregate: part of the known values that equal ``absent``; NULL when none is known."""
    return F.avg(F.when(C(field).isNotNull(), (C(field) == F.lit(absent)).cast("double")))


def _known_sum(field: str) -> Column:
    return F.coalesce(F.sum(C(field)), F.lit(0))


def catchment_facts(
    centres: DataFrame,
    villages: DataFrame,
    works: DataFrame | None = None,
    schemes: DataFrame | None = None,
    water_tests: DataFrame | None = None,
    employment: DataFrame | None = None,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """All sums and shares of a centre's catchment; every centre keeps a row."""
    near = villages_near(centres, villages.select("place_id", "p_lat", "p_lon"), cfg).select("group_id", "place_id")
    wide = near.join(villages.drop("p_lat", "p_lon"), "place_id")
    extra: list[Column] = []
    if works is not None:
        wide = wide.join(works_by_place(works, cfg), "place_id", "left")
        extra += [
            _known_sum("undelivered_works").alias("undelivered_works"),
            portable_round(F.coalesce(F.sum("undelivered_cost"), F.lit(0.0)), 2).alias("undelivered_cost_lakh"),
            F.min("oldest_year").alias("oldest_undelivered_year")]
    if schemes is not None:
        wide = wide.join(schemes_by_place(schemes, cfg), "place_id", "left")
        extra += [
            _known_sum("schemes").alias("schemes_found"), _known_sum("undelivered_schemes").alias("undelivered_schemes"),
            portable_round(F.coalesce(F.sum("unspent_lakh"), F.lit(0.0)), 2).alias("unspent_estimate_lakh")]
    if water_tests is not None:
        wide = wide.join(tests_by_place(water_tests), "place_id", "left")
        extra += [_known_sum("tested").alias("villages_tested"), _known_sum("samples").alias("samples_total")]
    if employment is not None:
        wide = wide.join(employment_by_place(employment), "place_id", "left")
        extra += [
            _known_sum("job_record").alias("job_villages"),
            *[portable_round(F.coalesce(F.sum("job_" + c), F.lit(0.0)), 2).alias("job_" + c)
              for c in ("total_lakh", "wages_lakh", "material_lakh")],
            F.array_join(F.array_sort(F.collect_set("job_year")), ",").alias("job_years")]
    rec = C("has_real_data")
    taps = C("jjm_tap_coverage_pct").isNotNull()
    fibre = F.nullif(C("conn_bharatnet_status"), F.lit(""))
    unpaved_large = rec & (C("road_all_weather") == 0) & (F.coalesce("population", F.lit(0)) >= cfg.road_min_population)
    short_school = (C("school_middle") == 0) | C("school_primary_nearest_band").isin("b", "c")
    below_full = taps & (C("jjm_tap_coverage_pct") < cfg.full_tap_coverage)
    facts = wide.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("villages"), _known_sum("population").alias("people"),
        F.count_if(rec).alias("records"),
        share("road_all_weather", 0).alias("no_all_weather"), share("road_black_topped", 0).alias("no_black_top"),
        F.count_if(taps).alias("tap_villages"),
        F.coalesce(F.sum(F.when(taps, F.coalesce("jjm_households", F.lit(0)))), F.lit(0)).alias("tap_households"),
        F.sum(F.when(taps, C("jjm_tap_coverage_pct") / 100.0 * F.coalesce("jjm_households", F.lit(0))))
        .alias("tap_weighted"),
        F.avg(C("jjm_tap_coverage_pct")).alias("tap_mean"),
        share("water_tap_treated", 0).alias("no_treated"), share("water_tap_treated_summer", 0).alias("fails_summer"),
        _known_sum("health_subcentre_count").alias("subcentres"), _known_sum("health_phc_count").alias("phcs"),
        _known_sum("health_chc_count").alias("chcs"),
        F.count_if(C("health_nearest_band").isin("b", "c")).alias("far_villages"),
        _known_sum("health_doctors_sanctioned").alias("doctors"),
        _known_sum("health_doctors_in_position").alias("doctors_present"),
        share("school_middle", 0).alias("no_middle"), share("school_secondary", 0).alias("no_secondary"),
        F.avg("power_domestic_summer_hrs").alias("power_hours"),
        share("drainage_none", 1).alias("no_drainage"), share("conn_internet_csc", 0).alias("no_internet"),
        F.count(fibre).alias("fibre_known"),
        F.count_if(F.upper(fibre).isin(*cfg.impaired_statuses)).alias("fibre_impaired"),
        F.avg("dist_nearest_town_km").alias("town_km"),
        F.count_if(unpaved_large).alias("road_qualifying"), F.count_if(rec & short_school).alias("school_short"),
        F.count_if(below_full).alias("tap_short"),
        F.min(F.when(below_full, C("jjm_tap_coverage_pct"))).alias("tap_lowest"),
        *extra)
    zero = [c for c in facts.columns if c in {
        "villages", "people", "records", "undelivered_works", "undelivered_schemes", "schemes_found", "villages_tested",
        "samples_total", "job_villages", "tap_villages", "tap_households"}]
    return centres.select("group_id", "category").join(facts, "group_id", "left").na.fill(0, zero)


# ---- deficits as columns over the facts

def road_deficit() -> Column:
    n = C("undelivered_works").cast("double")
    built = F.when(n > 0, F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * n))
    return F.coalesce(F.greatest(C("no_all_weather"), C("no_black_top"), built), F.lit(0.0))


def tap_coverage() -> Column:
    return F.when(C("tap_villages") > 0, F.when(C("tap_households") > 0, C("tap_weighted") / C("tap_households"))
                  .otherwise(C("tap_mean") / 100.0))


def water_deficit() -> Column:
    census = F.coalesce(F.greatest(C("no_treated"), C("fails_summer")), F.lit(0.0))
    return F.when(C("tap_villages") > 0, clamp01(F.lit(1.0) - tap_coverage())).otherwise(census)


def health_deficit(cfg: Settings = DEFAULTS) -> Column:
    people = C("people").cast("double")
    sub = people / F.lit(float(cfg.people_per_subcentre))
    phc = people / F.lit(float(cfg.people_per_phc))
    sub_short = F.when(people > 0, F.greatest(F.lit(0.0), (sub - C("subcentres")) / F.nullif(sub, F.lit(0.0))))
    phc_short = F.when(phc >= 1, F.greatest(F.lit(0.0), (phc - C("phcs")) / F.nullif(phc, F.lit(0.0))))
    far = F.when(C("far_villages") > 0, C("far_villages") / F.nullif(C("records"), F.lit(0)))
    vacant = F.when(C("doctors") > 0, F.greatest(
        F.lit(0.0), (C("doctors") - C("doctors_present")) / F.nullif(C("doctors"), F.lit(0))))
    return clamp01(F.coalesce(F.greatest(sub_short, phc_short, far, vacant), F.lit(0.0)))


def education_deficit() -> Column:
    return clamp01(F.coalesce(F.greatest(C("no_middle"), C("no_secondary") * 0.7), F.lit(0.0)))


def infra_deficit(category: Column, cfg: Settings = DEFAULTS) -> Column:
    """Deficit of the category against the records; NULL when the catchment has none."""
    value = (
        F.when(category == "road", road_deficit()).when(category == "water", water_deficit())
        .when(category == "health", health_deficit(cfg)).when(category == "education", education_deficit())
    )
    return F.when(C("records") > 0, value)


def vulnerability() -> Column:
    power = clamp01((F.lit(24.0) - C("power_hours")) / 24.0)
    known = F.filter(F.array(power, C("no_drainage"), C("no_internet")), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))
    return F.when(C("records") > 0, clamp01(mean))


def reporting_deficit() -> Column:
    return C("fibre_impaired") / F.nullif(C("fibre_known"), F.lit(0))


def scheme_eligible(category: Column, cfg: Settings = DEFAULTS) -> Column:
    """True / False by the published rule; NULL when the catchment has no records."""
    entitled = C("people") / F.lit(float(cfg.people_per_subcentre))
    rule = (
        F.when(category == "road", C("road_qualifying") > 0).when(category == "health", entitled > C("subcentres"))
        .when(category == "education", C("school_short") > 0).when(category == "water", C("tap_short") > 0)
    )
    return F.when(C("records") > 0, rule)


def eligibility_scheme(category: Column) -> Column:
    return (
        F.when(category == "road", "PMGSY")
        .when(category == "health", F.when(scheme_eligible(category), "IPHS / National Health Mission").otherwise("IPHS"))
        .when(category == "education",
              F.when(scheme_eligible(category), "RTE Act 2009 (statutory duty)").otherwise("RTE Act 2009"))
        .when(category == "water", "Jal Jeevan Mission")
    )


def road_connected_share() -> Column:
    return F.when(C("records") > 0, portable_round(F.lit(1.0) - C("no_all_weather"), 3))


def infra_source(category: Column) -> Column:
    taps = F.when(C("tap_villages") > 0, "jal_jeevan_mission_current").when(
        C("no_treated").isNotNull() | C("fails_summer").isNotNull(), "census_2011_may_overstate")
    return F.when((category == "water") & (C("records") > 0), taps)


# ---- schools

def school_deficit() -> Column:
    """Worst recorded shortfall of one school row; 0 when the row shows none."""
    total = F.coalesce("classrooms_total", F.lit(0))
    rooms = F.when(total > 0, F.coalesce("classrooms_major_repair", F.lit(0)) / F.nullif(total, F.lit(0)))
    no_power = F.when(~C("electricity"), 1.0)
    no_water = F.when(~C("drinking_water"), 1.0)
    no_toilet = F.when((C("toilet_boys_functional") == 0) | (C("toilet_girls_functional") == 0), 1.0)
    return F.coalesce(F.greatest(rooms, no_power, no_water, no_toilet), F.lit(0.0))


def latest_school_rows(school_rows: DataFrame) -> DataFrame:
    usable = school_rows.filter(~C("fetch_failed") & C("facility_id").isNotNull())
    return latest_by(usable, ["facility_id"], ["id"])


# ---- lists

def top_array(df: DataFrame, key: str, order: list[Column], item: Column, n: int, name: str) -> DataFrame:
    """First ``n`` items per key in ``order`` as an array; the limit is applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("_rn", F.row_number().over(w)).filter(C("_rn") <= n)
    rows = F.array_sort(F.collect_list(F.struct(C("_rn").alias("rn"), item.alias("item"))))
    return top.groupBy(key).agg(F.transform(rows, lambda r: r["item"]).alias(name))


def cost_per_km(works: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Median sanctioned cost per kilometre over priced works, when at least five are priced."""
    priced = works.filter("place_id is not null and cost_lakh > 0 and length_km > 0")
    middle = quantile(priced, C("cost_lakh") / C("length_km"), 0.5, "_m").withColumn("_one", F.lit(1))
    sampled = priced.agg(F.count(F.lit(1)).alias("works_sampled")).filter("works_sampled >= 5").withColumn("_one", F.lit(1))
    return sampled.join(middle, "_one").select(portable_round(C("_m"), 2).alias("median_lakh_per_km"), "works_sampled")


def headquarters_distance(centres: DataFrame, places: DataFrame) -> DataFrame:
    """Distance of the nearest block headquarters, however far."""
    from .spatial import nearest_any

    hq = places.filter("admin_level = 'block'").select(
        C("id").alias("hq_id"), C("lat").alias("p_lat"), C("lon").alias("p_lon"))
    return nearest_any(centres, hq, "group_id", ["hq_id"]).select("group_id", C("km").alias("hq_km"), "hq_id")
