"""Registers landed as files, normalised to the tables the operators read.

``read_*`` opens files; the function beside it takes the opened rows, so it also serves rows that come from elsewhere.
Text that cannot be read as the wanted type becomes NULL and never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinates
from ..functions.rounding import portable_round
from ..functions.text import before_comma, last_path_part, safe_bool, safe_float, safe_int
from ..operators.lookup import latest_by

C = F.col


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; headers as they stand in the file."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines)


def col_named(name: str) -> Column:
    return F.col(f"`{name}`")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


# ---- wide census table

# What to look for in the headers of the census table.
CENSUS_STATUS = {
    "road_black_topped": "Black.Topped", "road_all_weather": "All.Weather.Road..Status",
    "road_gravel": "Gravel..kuchha", "road_national_highway": "National.Highway..Status",
    "road_state_highway": "State.Highway..Status", "water_tap_treated": "Tap.Water.Treated..Status",
    "water_tap_treated_all_year": "Tap.Water.Treated.Functioning.All.round",
    "water_tap_treated_summer": "Tap.Water.Treated.Functioning.in.Summer",
    "water_tap_untreated": "Tap.Water.Untreated..Status", "water_handpump": "Hand.Pump..Status",
    "water_well_covered": "Covered.Well..Status", "school_primary": "Govt.Primary.School..Status",
    "school_middle": "Govt.Middle..School..Status", "school_secondary": "Govt.Secondary.School..Status",
    "conn_mobile_coverage": "Mobile.Phone.Coverage", "conn_internet_csc": "Internet.Cafes",
    "conn_telephone": "Telephone..landlines", "conn_bus_public": "Public.Bus.Service",
    "drainage_none": "No..Drainage..Status",
}
CENSUS_COUNT = {
    "households": "Total...Households", "health_phc_count": "Primary.Health.Centre..Numbers.",
    "health_chc_count": "Community.Health.Centre..Numbers.",
    "health_subcentre_count": "Primary.Heallth.Sub.Centre..Numbers.",
    "health_doctors_sanctioned": "Primary.Health.Centre..Doctors.Total.Strength",
    "health_doctors_in_position": "Centre.Doctors.In.Position",
}
CENSUS_FLOAT = {
    "dist_subdistrict_hq_km": "Sub.District.Head.Quarter..Distance.in.km.",
    "dist_district_hq_km": "District.Head.Quarter...Distance.in.km.",
    "dist_nearest_town_km": "Nearest.Town.Distance.from.Village",
    "power_domestic_summer_hrs": "Power.Supply.For.Domestic.Use.Summer",
    "power_domestic_winter_hrs": "Power.Supply.For.Domestic.Use.Winter",
}
CENSUS_BAND_AFTER = {
    "school_primary_nearest_band": "Govt.Primary.School..Status",
    "health_nearest_band": "Primary.Heallth.Sub.Centre..Numbers.",
}
BAND_MARKER = "If.not.available"


def find_header(headers: list[str], needle: str, start: int = 0) -> str | None:
    low = needle.lower()
    return next((h for h in headers[start:] if low in h.lower()), None)


def census_status(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "1", 1).when(t == "2", 0)


def census_band(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("a", "b", "c"), t)


def census_amenities(rows: DataFrame) -> DataFrame:
    """Amenity columns beside the original ones; a header that is not there gives NULL."""
    headers = rows.columns

    def pick(needle: str, cast, kind: str) -> Column:
        h = find_header(headers, needle)
        return F.lit(None).cast(kind) if h is None else cast(col_named(h))

    out = {f: pick(n, census_status, "int") for f, n in CENSUS_STATUS.items()}
    out |= {f: pick(n, lambda c: F.when(F.trim(c).rlike("^-*[0-9]+$"), F.trim(c).try_cast("bigint")), "bigint")
            for f, n in CENSUS_COUNT.items()}
    out |= {f: pick(n, safe_float, "double") for f, n in CENSUS_FLOAT.items()}
    for field, anchor in CENSUS_BAND_AFTER.items():
        h = find_header(headers, anchor)
        band = None if h is None else find_header(headers, BAND_MARKER, headers.index(h))
        out[field] = F.lit(None).cast("string") if band is None else census_band(col_named(band))
    return rows.withColumns(out)


def census_population(rows: DataFrame, name: str = "Village.Name",
                      population: str = "Total.Population.of.Village") -> DataFrame:
    n, p = F.trim(col_named(name)), F.trim(col_named(population))
    return rows.filter((n != "") & p.rlike("^[0-9]+$")).select(n.alias("name"), p.cast("bigint").alias("population"))


# ---- GeoJSON registers

SCHOOL_FEATURES = (
    "features array<struct<properties:struct<schcd:string,schname:string,school_cat:string,management:string,"
    "vilname:string>,geometry:struct<coordinates:array<double>>>>")
HEALTH_FEATURES = (
    "features array<struct<properties:struct<state:string,district:string,type:string,source_id:string,name:string,"
    "place:string>,geometry:struct<coordinates:array<double>>>>")


def features(documents: DataFrame) -> DataFrame:
    """One row per feature with a usable point: properties, lat, lon."""
    f = documents.select(F.explode("features").alias("f")).select("f.properties", C("f.geometry.coordinates").alias("xy"))
    lon, lat = F.try_element_at("xy", F.lit(1)), F.try_element_at("xy", F.lit(2))
    usable = (F.size("xy") == 2) & (lat != 0) & (lon != 0)
    return f.filter(F.coalesce(usable, F.lit(False))).select("properties", lat.alias("lat"), lon.alias("lon"))


def school_register(documents: DataFrame, district: str) -> DataFrame:
    p = "properties."
    return features(documents).select(
        F.lit("udise").alias("source"), blank_to_null(C(p + "schcd")).alias("external_id"),
        blank_to_null(C(p + "schname")).alias("name"), F.lit("education").alias("category"),
        blank_to_null(C(p + "school_cat")).alias("sub_type"), blank_to_null(C(p + "management")).alias("management"),
        blank_to_null(C(p + "vilname")).alias("village"), F.lit(None).cast("string").alias("block"),
        F.lit(district).alias("district"), "lat", "lon")


# Spellings and codes of the health register.
HEALTH_DISTRICTS = {"Kolhapur": "Kolhapur", "Nasik": "Nashik"}
HEALTH_TYPES = {
    "SCE": "Sub-centre", "PHC": "Primary Health Centre", "CHC": "Community Health Centre",
    "THO": "Taluka Health Office", "DHO": "District Health Office",
}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def health_register(documents: DataFrame, state: str = "MAHARASHTRA",
                    districts: dict[str, str] | None = None) -> DataFrame:
    p = "properties."
    code = blank_to_null(C(p + "type"))
    district = _mapped(blank_to_null(C(p + "district")), districts or HEALTH_DISTRICTS)
    return features(documents).filter(F.upper(C(p + "state")) == state).select(
        F.lit("nic_healthgis").alias("source"), blank_to_null(C(p + "source_id")).alias("external_id"),
        blank_to_null(C(p + "name")).alias("name"), F.lit("health").alias("category"),
        F.coalesce(_mapped(code, HEALTH_TYPES), code).alias("sub_type"), F.lit("Government").alias("management"),
        before_comma(blank_to_null(C(p + "place"))).alias("village"), F.lit(None).cast("string").alias("block"),
        district.alias("district"), "lat", "lon").filter("district is not null")


# ---- fibre nodes, works, roads, floods

def _key(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def fibre_nodes(statuses: DataFrame, locations: DataFrame, code: str | None = None) -> DataFrame:
    """Located nodes with their status where one is recorded for (district, block, council).

    ``statuses``: district, block, gp, status. ``locations``: district, block, gp, lat, lon, all text. ``code``: a column of both that
    tells councils of one name in a block apart; without it they share a status.
    """
    parts = ["district", "block", "gp", *([code] if code else [])]
    key = [_key(C(c).cast("string")).alias("_" + c) for c in parts]
    on = ["_" + c for c in parts]
    s = statuses.select(*key, F.trim(F.coalesce("status", F.lit(""))).alias("status")).groupBy(
        *on).agg(F.max("status").alias("status"))
    lat, lon = safe_float(C("lat")), safe_float(C("lon"))
    n = locations.withColumns({"_lat": lat, "_lon": lon}).filter(valid_coordinates(C("_lat"), C("_lon")))
    return n.select(*key, F.trim("gp").alias("gp"), F.trim("block").alias("block"), "_lat", "_lon").join(
        s, on, "left").select(
        C("_district").alias("district"), "block", "gp", "status", C("_lat").alias("lat"), C("_lon").alias("lon"))


def road_works(rows: DataFrame, district: str | Column) -> DataFrame:
    """Sanctioned works from the dashboard's field names."""
    year = safe_int(C("IMS_YEAR"))
    return rows.select(
        F.lit("pmgsy_dashboard").alias("source"), C("IMS_PR_ROAD_CODE").alias("external_id"),
        blank_to_null(C("IMS_PACKAGE_ID")).alias("package_id"), blank_to_null(C("PMGSY_SCHEME_NAME")).alias("scheme_name"),
        blank_to_null(C("IMS_ROAD_NAME")).alias("work_name"), blank_to_null(C("IMS_ROAD_FROM")).alias("road_from"),
        blank_to_null(C("IMS_ROAD_TO")).alias("road_to"),
        (F.lit(district) if isinstance(district, str) else district).alias("district"),
        F.when(year.between(1990, 2100), year).alias("sanction_year"),
        safe_float(C("TOTAL_SANCTIONED_COST")).alias("cost_lakh"), safe_float(C("IMS_PAV_LENGTH")).alias("length_km"),
        F.coalesce(blank_to_null(C("WORK_STATUS")), F.lit("Unknown")).alias("status"))


def road_segments(shapes: DataFrame, blocks: DataFrame, districts: DataFrame) -> DataFrame:
    """Polylines from (lon, lat) points: rounded vertices, ends, box and block name.

    ``shapes``: road_id, district_id, block_id, road_code, road_name, road_category, road_owner, xy
    array<struct<lon,lat>>. ``blocks``: block_id, block. ``districts``: district_id, district (others are dropped).
    """
    pts = F.transform("xy", lambda p: F.struct(
        portable_round(p["lat"], 6).alias("lat"), portable_round(p["lon"], 6).alias("lon")))
    t = shapes.filter(F.size("xy") > 0).join(districts, "district_id").join(blocks, "block_id", "left").withColumn(
        "points", pts)
    lats, lons = F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"])
    return t.select(
        C("road_id").alias("external_id"), "district_id", "district", "block_id", "block",
        *[blank_to_null(C(c)).alias(c) for c in ("road_code", "road_name", "road_category", "road_owner")], "points",
        F.element_at("points", 1)["lat"].alias("start_lat"), F.element_at("points", 1)["lon"].alias("start_lon"),
        F.element_at("points", -1)["lat"].alias("end_lat"), F.element_at("points", -1)["lon"].alias("end_lon"),
        F.size("points").alias("point_count"), F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"),
        F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"))


def road_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("district", "road_category").agg(F.count(F.lit(1)).alias("n"))


def flood_boxes(polygons: DataFrame, source: str, loaded: DataFrame | None = None) -> DataFrame:
    """Nested boxes flattened; nothing when this source is already loaded."""
    rows = polygons.filter("bbox is not null").select(
        C("year").cast("string").alias("flood_year"), *[C("bbox." + c).cast("double").alias(c)
                                                        for c in ("xmin", "ymin", "xmax", "ymax")],
        F.lit(source).alias("source"))
    return rows if loaded is None else rows.join(loaded.select("source").distinct(), "source", "left_anti")


# ---- water, money, schools, hierarchy, places

def tap_coverage(habitations: DataFrame) -> DataFrame:
    """Village coverage over summed households; villages without households are left out.

    ``habitations``: village, Household, HouseholdConn, QualityStatus, all text.
    """
    total, taps = safe_int(C("Household")), safe_int(C("HouseholdConn"))
    quality = F.trim(F.coalesce("QualityStatus", F.lit("")))
    named = F.when((quality != "") & (F.lower(quality) != "none"), quality)
    t = habitations.groupBy("village").agg(
        F.coalesce(F.sum(total), F.lit(0)).alias("jjm_households"),
        F.coalesce(F.sum(taps), F.lit(0)).alias("jjm_households_with_tap"),
        F.count(F.lit(1)).alias("jjm_habitation_count"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(named)), "; "), F.lit("")).alias("jjm_quality_status"))
    return t.filter("jjm_households > 0").withColumns({
        "jjm_tap_coverage_pct": portable_round(C("jjm_households_with_tap") * 100.0 / C("jjm_households"), 2),
        "village_name": last_path_part(C("village"))})


def water_tests(rows: DataFrame, places: DataFrame, fin_year: str, threshold: float = 88.0) -> DataFrame:
    """Testing rows keyed by (fin_year, district, village_id), linked to a place by name."""
    from ..operators.fuzzy import best_match

    good = rows.filter("VillageName is not null and trim(VillageName) <> '' and VillageName <> '--Select--'")
    keyed = good.withColumns({"id": F.xxhash64("district", "VillageId"), "name": C("VillageName")})
    links = best_match(keyed.select("id", "district", "name").distinct(), places.select("id", "district", "name"), threshold)
    return keyed.join(links.select("id", C("match_id").alias("place_id")), "id", "left").select(
        F.lit(fin_year).alias("fin_year"), "district", C("VillageId").alias("village_id"), "place_id",
        C("VillageName").alias("village_name"),
        F.coalesce(safe_int(C("Nos_of_Sample_tested")), F.lit(0)).alias("samples_tested"),
        F.coalesce(safe_int(C("Nos_of_Villages_FTK_testing_not_carried")), F.lit(0)).alias("villages_not_tested"))


def panchayat_finance(rows: DataFrame, fin_year: str | Column) -> DataFrame:
    """Receipts are direct plus automatic; a missing half counts zero."""
    def both(kind: str) -> Column:
        return (F.coalesce(C(kind + "ReceiptDirect").cast("double"), F.lit(0.0))
                + F.coalesce(C(kind + "ReceiptAuto").cast("double"), F.lit(0.0)))

    name = F.coalesce(blank_to_null(C("bpName")), blank_to_null(C("zpName")))
    return rows.filter(name.isNotNull()).select(
        name.alias("village_name"), "district", (F.lit(fin_year) if isinstance(fin_year, str) else fin_year).alias("fin_year"),
        both("untied").alias("untied_receipts"), C("untiedPaymentAmount").cast("double").alias("untied_payments"),
        both("tied").alias("tied_receipts"), C("tiedPaymentAmount").cast("double").alias("tied_payments"),
        F.to_json(F.struct(*rows.columns)).alias("raw_json"))


def school_condition(report_cards: DataFrame, facility_rows: DataFrame, wanted: DataFrame, year: str) -> DataFrame:
    """Two payloads per school merged on its code; a school without either keeps a row marked as failed.

    ``wanted``: facility_id, code. The payloads hold text fields.
    """
    rc = report_cards.select(
        "code", C("yearDesc"), *[safe_int(C(c)).alias(c) for c in ("tchReg", "tchCont", "tchPart")],
        safe_float(C("totalGrant")).alias("total_grant"),
        safe_float(F.coalesce("totalExpediture", "totalExpenditure")).alias("total_expenditure"),
        F.to_json(F.struct(*report_cards.columns)).alias("_rc"), F.lit(True).alias("_has_rc"))
    fac = facility_rows.select(
        "code", *[safe_int(C(c)).alias(c) for c in (
            "clsrmsInst", "clsrmsGd", "clsrmsMin", "clsrmsMaj", "toiletbFun", "toiletgFun")],
        safe_bool(C("drinkWaterYn")).alias("drinking_water"), safe_bool(C("electricityYn")).alias("electricity"),
        blank_to_null(C("bndrywallType")).alias("boundary_wall_status"),
        F.to_json(F.struct(*facility_rows.columns)).alias("_fac"), F.lit(True).alias("_has_fac"))
    both = rc.join(fac, "code", "full_outer")
    t = wanted.join(both, "code", "left")
    got = C("_has_rc").isNotNull() | C("_has_fac").isNotNull()
    return t.select(
        "facility_id", C("code").alias("udise_code"), F.coalesce("yearDesc", F.lit(year)).alias("year_desc"),
        C("tchReg").alias("teachers_regular"), C("tchCont").alias("teachers_contract"),
        C("tchPart").alias("teachers_part_time"), C("clsrmsInst").alias("classrooms_total"),
        C("clsrmsGd").alias("classrooms_good"), C("clsrmsMin").alias("classrooms_minor_repair"),
        C("clsrmsMaj").alias("classrooms_major_repair"), C("toiletbFun").alias("toilet_boys_functional"),
        C("toiletgFun").alias("toilet_girls_functional"), "drinking_water", "electricity", "boundary_wall_status",
        "total_grant", "total_expenditure", (~got).alias("fetch_failed"),
        F.when(got, F.to_json(F.struct(C("_rc").alias("report_card"), C("_fac").alias("facility")))).alias("raw_json"))


def hierarchy(rows: DataFrame, state: str, districts: dict[str, str]) -> DataFrame:
    """Official villages of one state; absent codes are written 0 or blank."""
    def clean(name: str) -> Column:
        return F.nullif(blank_to_null(col_named(name)), F.lit("0"))

    district = _mapped(F.trim(col_named("District Name (In English)")), districts)
    return rows.filter(F.trim(col_named("State Name (In English)")) == state).select(
        clean("Village Code").alias("village_code"), clean("Village Name (In English)").alias("name"),
        clean("Village Census 2011 Code").alias("census_code"), clean("Subdistrict Code").alias("subdistrict_code"),
        clean("Subdistrict Name (In English)").alias("subdistrict"), clean("Development Block Code").alias("block_code"),
        clean("Development Block Name (In English)").alias("block"), district.alias("district")
    ).filter("district is not null")


PLACE_ELEMENTS = "elements array<struct<lat:double,lon:double,tags:struct<name:string,population:string>>>"
LEAST_PLACES = 5


def place_elements(documents: DataFrame, district: str | Column, fallback: DataFrame | None = None) -> DataFrame:
    """Named places with a point; the curated rows instead when fewer than five are left."""
    e = documents.select(F.explode("elements").alias("e"), (F.lit(district) if isinstance(district, str) else district).alias("district"))
    pop = C("e.tags.population")
    rows = e.filter("e.tags.name is not null and e.tags.name <> '' and e.lat is not null and e.lon is not null").select(
        C("e.tags.name").alias("name"), F.lit("village").alias("admin_level"), "district",
        F.lit(None).cast("string").alias("block"),
        F.when(pop.rlike("^[0-9]+$"), pop.try_cast("bigint")).alias("population"), C("e.lat").alias("lat"),
        C("e.lon").alias("lon"))
    if fallback is None:
        return rows
    enough = rows.groupBy("district").agg(F.count(F.lit(1)).alias("_n")).filter(C("_n") >= LEAST_PLACES).select("district")
    return rows.join(enough, "district", "left_semi").unionByName(
        fallback.join(enough, "district", "left_anti"), allowMissingColumns=True)
