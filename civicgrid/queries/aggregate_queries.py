"""Aggregations over groups, catchments and registers."""

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import catchment as K
from ..operators import cluster, emergency, hazards, photos
from ..operators.lookup import modal
from . import sqltext as S
from .registry import query, register
from .spatial_queries import CATCH
from .views import AS_OF, AS_OF_SQL

C = F.col
BASE = "centres village_records works schemes water_tests employment"

WHO = "CASE WHEN user_id IS NOT NULL THEN 'account:' || user_id ELSE 'text:' || lower(trim(coalesce(raw_text, ''))) END"

register(
    "agg_01_distinct_reporters", "AGG-01", "group_id:i reporters:i",
    lambda v: cluster.reporter_count(v.grouped, ["group_id"]),
    f"SELECT group_id, count(DISTINCT {WHO}) AS reporters FROM grouped GROUP BY group_id", "grouped")


@query("agg_02_modal_block", "AGG-02", "group_id:i block:s",
       """SELECT group_id, block FROM (SELECT group_id, block, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, f) AS rn
          FROM (SELECT group_id, block, count(*) AS n, min(id) AS f FROM grouped WHERE block <> '' GROUP BY 1, 2) x) y
          WHERE rn = 1""", "grouped")
def modal_block(v):
    return modal(v.grouped, ["group_id"], "block", "id")


register(
    "agg_03_settlements", "AGG-03", "group_id:i settlements:i",
    lambda v: v.grouped.groupBy("group_id").agg(F.count_distinct("village").alias("settlements")),
    "SELECT group_id, count(DISTINCT village) AS settlements FROM grouped GROUP BY group_id", "grouped")


def facts(v):
    return K.catchment_facts(v.centres, v.village_records, v.works, v.schemes, v.water_tests, v.employment)


def shr(field: str, absent, of: str = "{f} IS NOT NULL") -> str:
    return f"avg(CASE WHEN {field} IS NOT NULL THEN CASE WHEN {field} = {absent} THEN 1e0 ELSE 0e0 END END)"


OPEN = "('Not Started', 'In Progress', 'Agreement Cancelled')"
FACTS = f"""{CATCH},
w1 AS (SELECT place_id, count(*) FILTER (status IN {OPEN}) AS n, sum(coalesce(cost_lakh, 0)) FILTER (status IN {OPEN}) AS cost,
       min(sanction_year) FILTER (status IN {OPEN}) AS oldest FROM works WHERE place_id IS NOT NULL GROUP BY 1),
s1 AS (SELECT place_id, count(*) AS n, count(*) FILTER (o) AS un,
       sum(greatest(0, coalesce(estimated_lakh, 0) - coalesce(spent_lakh, 0))) FILTER (o) AS rest
       FROM (SELECT *, lower(trim(coalesce(status, ''))) IN ('ongoing', 'in progress', 'not started') AS o FROM schemes) GROUP BY 1),
t1 AS (SELECT place_id, arg_max(coalesce(samples_tested, 0), id) AS samples FROM water_tests WHERE place_id IS NOT NULL GROUP BY 1),
j1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY fin_year DESC, id DESC) AS rn FROM employment
       WHERE place_id IS NOT NULL) WHERE rn = 1),
facts0 AS (SELECT k.group_id, count(*) AS villages, sum(population) AS people, count(*) FILTER (has_real_data) AS records,
  {shr('road_all_weather', 0)} AS no_all_weather, {shr('road_black_topped', 0)} AS no_black_top,
  count(jjm_tap_coverage_pct) AS tap_villages, sum(CASE WHEN jjm_tap_coverage_pct IS NOT NULL THEN coalesce(jjm_households, 0) END) AS tap_households,
  sum(jjm_tap_coverage_pct / 100 * coalesce(jjm_households, 0)) AS tap_weighted, avg(jjm_tap_coverage_pct) AS tap_mean,
  {shr('water_tap_treated', 0)} AS no_treated, {shr('water_tap_treated_summer', 0)} AS fails_summer,
  coalesce(sum(health_subcentre_count), 0) AS subcentres, coalesce(sum(health_phc_count), 0) AS phcs,
  count(*) FILTER (health_nearest_band IN ('b', 'c')) AS far_villages,
  coalesce(sum(health_doctors_sanctioned), 0) AS doctors, coalesce(sum(health_doctors_in_position), 0) AS doctors_present,
  {shr('school_middle', 0)} AS no_middle, {shr('school_secondary', 0)} AS no_secondary,
  avg(power_domestic_summer_hrs) AS power_hours, {shr('drainage_none', 1)} AS no_drainage,
  {shr('conn_internet_csc', 0)} AS no_internet, count(nullif(conn_bharatnet_status, '')) AS fibre_known,
  count(*) FILTER (upper(conn_bharatnet_status) IN ('DOWN', 'UNKNOWN PREV DOWN', 'NO_STATUS_RECORDED', '#N/A', 'NOT VISIBLE IN NOC')) AS fibre_impaired,
  avg(dist_nearest_town_km) AS town_km,
  count(*) FILTER (road_all_weather = 0 AND coalesce(population, 0) >= 500) AS road_qualifying,
  count(*) FILTER (school_middle = 0 OR school_primary_nearest_band IN ('b', 'c')) AS school_short,
  count(*) FILTER (jjm_tap_coverage_pct < 100) AS tap_short, min(CASE WHEN jjm_tap_coverage_pct < 100 THEN jjm_tap_coverage_pct END) AS tap_lowest,
  coalesce(sum(w1.n), 0) AS undelivered_works, {S.rnd('coalesce(sum(w1.cost), 0)', 2)} AS undelivered_cost_lakh, min(w1.oldest) AS oldest_undelivered_year,
  coalesce(sum(s1.n), 0) AS schemes_found, coalesce(sum(s1.un), 0) AS undelivered_schemes, {S.rnd('coalesce(sum(s1.rest), 0)', 2)} AS unspent_estimate_lakh,
  count(t1.place_id) AS villages_tested, coalesce(sum(t1.samples), 0) AS samples_total, count(j1.place_id) AS job_villages,
  {S.rnd('coalesce(sum(j1.total_lakh), 0)', 2)} AS job_total_lakh, {S.rnd('coalesce(sum(j1.wages_lakh), 0)', 2)} AS job_wages_lakh,
  {S.rnd('coalesce(sum(j1.material_lakh), 0)', 2)} AS job_material_lakh, coalesce(string_agg(DISTINCT j1.fin_year, ',' ORDER BY j1.fin_year), '') AS job_years
  FROM catch k LEFT JOIN w1 USING (place_id) LEFT JOIN s1 USING (place_id) LEFT JOIN t1 USING (place_id) LEFT JOIN j1 USING (place_id)
  GROUP BY k.group_id),
facts AS (SELECT c.group_id, c.category, c.lat, c.lon, coalesce(f.villages, 0) AS villages, coalesce(f.people, 0) AS people,
  coalesce(f.records, 0) AS records, f.* EXCLUDE (group_id, villages, people, records) FROM centres c LEFT JOIN facts0 f USING (group_id))"""

ROAD = "coalesce(greatest(no_all_weather, no_black_top, CASE WHEN undelivered_works > 0 THEN least(1e0, 0.5e0 + 0.1e0 * undelivered_works) END), 0e0)"
COVER = "CASE WHEN tap_households > 0 THEN tap_weighted / tap_households ELSE tap_mean / 100 END"
WATER = f"CASE WHEN tap_villages > 0 THEN {S.clamp('1 - ' + COVER.join('()'))} ELSE coalesce(greatest(no_treated, fails_summer), 0e0) END"
HEALTH = S.clamp(
    "coalesce(greatest(CASE WHEN people > 0 THEN greatest(0e0, (people / 5000e0 - subcentres) / (people / 5000e0)) END,"
    " CASE WHEN people / 30000e0 >= 1 THEN greatest(0e0, (people / 30000e0 - phcs) / (people / 30000e0)) END,"
    " CASE WHEN far_villages > 0 THEN far_villages / (records * 1e0) END,"
    " CASE WHEN doctors > 0 THEN greatest(0e0, (doctors - doctors_present) / (doctors * 1e0)) END), 0e0)")
EDU = S.clamp("coalesce(greatest(no_middle, no_secondary * 0.7e0), 0e0)")
INFRA = (f"CASE WHEN records > 0 THEN CASE category WHEN 'road' THEN {ROAD} WHEN 'water' THEN {WATER}"
         f" WHEN 'health' THEN {HEALTH} WHEN 'education' THEN {EDU} END END")
VULN = ("CASE WHEN records > 0 THEN " + S.clamp("list_avg(list_filter([" + S.clamp("(24 - power_hours) / 24")
        + " + power_hours * 0, no_drainage, no_internet], lambda x: x IS NOT NULL))")
        + " + list_avg(list_filter([power_hours, no_drainage, no_internet], lambda x: x IS NOT NULL)) * 0 END")
FIBRE = "CASE WHEN fibre_known > 0 THEN fibre_impaired / (fibre_known * 1e0) END"
ELIGIBLE = ("CASE WHEN records > 0 THEN CASE category WHEN 'road' THEN road_qualifying > 0 WHEN 'health' THEN"
            " people / 5000e0 > subcentres WHEN 'education' THEN school_short > 0 WHEN 'water' THEN tap_short > 0 END END")
ROADSHARE = f"CASE WHEN records > 0 THEN {S.rnd('1 - no_all_weather', 3)} END"


def fact_query(key, op, columns: dict):
    spec = "group_id:i " + " ".join(columns)
    names = {k.split(":")[0]: x for k, x in columns.items()}
    register(
        key, op, spec, lambda v: facts(v).select("group_id", *[x[0]().alias(n) for n, x in names.items()]),
        f"WITH {FACTS} SELECT group_id, " + ", ".join(f"{x[1]} AS {n}" for n, x in names.items()) + " FROM facts", BASE)


def same(*names):
    return {n: ((lambda c=n.split(":")[0]: C(c)), n.split(":")[0]) for n in names}


fact_query("agg_04_known_shares", "AGG-04", same(
    "no_all_weather:d", "no_black_top:d", "no_middle:d", "no_secondary:d", "no_drainage:d", "no_internet:d"))
fact_query("agg_05_road_deficit", "AGG-05", {
    "deficit:d": (K.road_deficit, ROAD),
    **same("undelivered_works:i", "undelivered_cost_lakh:d", "oldest_undelivered_year:i")})
fact_query("agg_06_water_deficit", "AGG-06", {
    "deficit:d": (K.water_deficit, WATER), **same("tap_villages:i")})
fact_query("agg_07_health_deficit", "AGG-07", {
    "deficit:d": (K.health_deficit, HEALTH), **same("subcentres:i", "phcs:i", "doctors:i")})
fact_query("agg_08_education_deficit", "AGG-08", {"deficit:d": (K.education_deficit, EDU)})
fact_query("agg_09_infra_deficit", "AGG-09", {
    "infra:d": (lambda: K.infra_deficit(C("category")), INFRA), **same("records:i", "category:s")})
SCHOOL = """greatest(CASE WHEN coalesce(classrooms_total, 0) > 0 THEN coalesce(classrooms_major_repair, 0) / (classrooms_total * 1e0) END,
  CASE WHEN NOT electricity THEN 1e0 END, CASE WHEN NOT drinking_water THEN 1e0 END,
  CASE WHEN toilet_boys_functional = 0 OR toilet_girls_functional = 0 THEN 1e0 END)"""
SCHOOLS = f"""schools AS (SELECT *, coalesce({SCHOOL}, 0e0) AS deficit FROM (SELECT *, row_number() OVER
  (PARTITION BY facility_id ORDER BY id DESC) AS rn FROM school_rows WHERE NOT fetch_failed AND facility_id IS NOT NULL) WHERE rn = 1)"""
register(
    "agg_10_school_deficit", "AGG-10", "facility_id:i deficit:d",
    lambda v: K.latest_school_rows(v.school_rows).select("facility_id", K.school_deficit().alias("deficit")),
    f"WITH {SCHOOLS} SELECT facility_id, deficit FROM schools", "school_rows")
fact_query("agg_11_vulnerability", "AGG-11", {"vulnerability:d": (K.vulnerability, VULN)})
fact_query("agg_12_fibre_impaired", "AGG-12", {
    "reporting_deficit:d": (K.reporting_deficit, FIBRE), **same("fibre_known:i", "fibre_impaired:i")})
fact_query("agg_13_scheme_eligibility", "AGG-13", {
    "eligible:b": (lambda: K.scheme_eligible(C("category")), ELIGIBLE),
    "scheme:s": (
        lambda: K.eligibility_scheme(C("category")),
        f"""CASE category WHEN 'road' THEN 'PMGSY' WHEN 'health' THEN CASE WHEN {ELIGIBLE} THEN 'IPHS / National Health Mission'
            ELSE 'IPHS' END WHEN 'education' THEN CASE WHEN {ELIGIBLE} THEN 'RTE Act 2009 (statutory duty)' ELSE 'RTE Act 2009' END
            WHEN 'water' THEN 'Jal Jeevan Mission' END"""),
    **same("road_qualifying:i", "school_short:i", "tap_short:i", "tap_lowest:d")})


@query("agg_13_qualifying_villages", "AGG-13", "group_id:i qualifying:s",
       f"""WITH {CATCH} SELECT group_id, string_agg(place_name, ',' ORDER BY place_id) AS qualifying FROM (
           SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY place_id) AS rn FROM catch
           WHERE category = 'road' AND road_all_weather = 0 AND coalesce(population, 0) >= 500) x WHERE rn <= 5
           GROUP BY group_id""", "centres village_records")
def qualifying(v):
    near = K.villages_near(v.centres, v.village_records).filter(
        (C("category") == "road") & (C("road_all_weather") == 0)
        & (F.coalesce("population", F.lit(0)) >= DEFAULTS.road_min_population))
    out = K.top_array(near, "group_id", [C("place_id")], C("place_name"), 5, "names")
    return out.select("group_id", F.array_join("names", ",").alias("qualifying"))


fact_query("agg_14_town_and_roads", "AGG-14", {
    **same("town_km:d"), "road_share:d": (K.road_connected_share, ROADSHARE)})
register(
    "agg_15_cost_per_km", "AGG-15", "median_lakh_per_km:d works_sampled:i", lambda v: K.cost_per_km(v.works),
    f"""SELECT {S.rnd('median(cost_lakh / length_km)', 2)} AS median_lakh_per_km, count(*) AS works_sampled FROM works
        WHERE place_id IS NOT NULL AND cost_lakh > 0 AND length_km > 0 HAVING count(*) >= 5""", "works")
fact_query("agg_16_catchment_sums", "AGG-16", same(
    "villages_tested:i", "samples_total:i", "schemes_found:i", "undelivered_schemes:i", "unspent_estimate_lakh:d",
    "job_villages:i", "job_total_lakh:d", "job_wages_lakh:d", "job_material_lakh:d", "job_years:s"))

BURST = f"""burst AS (SELECT group_id, CASE WHEN n < 3 THEN 0e0 ELSE (recent / 72e0) / (n / greatest(hours, 72e0)) END AS burst
  FROM (SELECT group_id, count(*) AS n, count(*) FILTER (t >= {AS_OF_SQL} - INTERVAL '72' HOUR) AS recent,
        epoch_us({AS_OF_SQL}) / 3.6e9 - epoch_us(min(t)) / 3.6e9 AS hours FROM (
        SELECT group_id, lower(trim(coalesce(raw_text, ''))) AS who, min(created_at) AS t FROM grouped
        WHERE created_at IS NOT NULL GROUP BY 1, 2) f GROUP BY group_id) g)"""
register(
    "agg_17_burst_ratio", "AGG-17", "group_id:i burst:d",
    lambda v: cluster.burst_ratio(v.grouped, ["group_id"], AS_OF),
    f"WITH {BURST} SELECT group_id, burst FROM burst", "grouped")

PHOTOS = """rolled AS (SELECT report_id, count(*) AS photos, count(*) FILTER (capture_method = 'live_camera') AS live_captures,
  count(*) FILTER (verdict = 'verified' AND authenticity IS NOT NULL) AS verified,
  count(*) FILTER (verdict = 'needs_review' AND authenticity IS NOT NULL) AS needs_review, min(authenticity) AS lowest_authenticity,
  count(authenticity) AS photos_checked, count(*) FILTER (defect_seen AND authenticity IS NOT NULL) AS showing_defect,
  count(*) FILTER (defect_seen AND authenticity IS NOT NULL AND coalesce(verdict, '') <> 'needs_review') AS trusted_defect,
  coalesce(max(pothole_confidence) FILTER (authenticity IS NOT NULL), 0) AS max_pothole,
  coalesce(max(crack_confidence) FILTER (authenticity IS NOT NULL), 0) AS max_crack,
  arg_max(damage_grade, struct_pack(g := CASE damage_grade WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 WHEN 'collapse' THEN 3 ELSE 0 END,
    c := coalesce(damage_confidence, 0), i := -attachment_id)) FILTER (authenticity IS NOT NULL AND damage_grade <> '' AND damage_structure <> '') AS worst_grade
  FROM photo_rows GROUP BY report_id)"""


@query("agg_18_photo_rollup", "AGG-18",
       "report_id:i photos:i live_captures:i verified:i needs_review:i lowest_authenticity:d photos_checked:i"
       " showing_defect:i trusted_defect:i max_pothole:d max_crack:d worst_grade:s",
       f"WITH {PHOTOS} SELECT * FROM rolled", "photo_rows")
def photo_rollup(v):
    return photos.rollup(v.photo_rows, ["report_id"]).withColumn("worst_grade", C("worst.damage_grade"))


@query("agg_20_high_share", "AGG-20", "group_id:i high_share:d mean_confidence:d",
       """SELECT group_id, avg(CASE WHEN lower(coalesce(severity, '')) = 'high' THEN 1e0 ELSE 0e0 END) AS high_share,
          coalesce(avg(confidence), 0) AS mean_confidence FROM grouped GROUP BY group_id""", "grouped")
def high_share(v):
    return v.grouped.groupBy("group_id").agg(*cluster.severity_profile())


@query("agg_21_location_basis", "AGG-21", "group_id:i asset_basis:s group_basis:s",
       """SELECT group_id, CASE WHEN NOT bool_or(precise_lat IS NOT NULL OR coalesce(pin_source, '') <> '') THEN 'village_centroid'
            WHEN bool_and(coalesce(src, '') = 'citizen_gps') THEN 'citizen_gps_pin'
            WHEN bool_and(coalesce(src, '') = 'synthetic_seed') THEN 'synthetic_seed' ELSE 'mixed' END AS asset_basis,
          CASE WHEN bool_and(pinned) THEN 'citizen_gps_pin' WHEN bool_or(pinned) THEN 'mixed' ELSE 'village_centroid' END AS group_basis
          FROM (SELECT *, CASE WHEN coalesce(pin_source, '') <> '' THEN pin_source WHEN precise_lat IS NOT NULL THEN 'citizen_gps' END AS src,
                precise_lat IS NOT NULL AND precise_lon IS NOT NULL AS pinned FROM grouped) x GROUP BY group_id""", "grouped")
def location_basis(v):
    return v.grouped.groupBy("group_id").agg(
        cluster.asset_location_basis().alias("asset_basis"), cluster.group_location_basis().alias("group_basis"))


@query("agg_22_group_profile", "AGG-22", "group_id:i all_synthetic:b sample_text:s villages_served:s",
       """SELECT group_id, bool_and(is_synthetic) AS all_synthetic,
          substr(arg_max(coalesce(raw_text, ''), struct_pack(n := length(coalesce(raw_text, '')), i := -id)), 1, 300) AS sample_text,
          coalesce(string_agg(DISTINCT village, ',' ORDER BY village), '') AS villages_served FROM grouped GROUP BY group_id""",
       "grouped")
def group_profile(v):
    return v.grouped.groupBy("group_id").agg(
        F.bool_and("is_synthetic").alias("all_synthetic"), cluster.sample_text().alias("sample_text"),
        F.array_join(F.array_sort(F.collect_set("village")), ",").alias("villages_served"))


WORDS = {}


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def emergency_sql(category: str = "issue_category") -> str:
    from .. import vocab as V

    road = f"({category} = 'road' AND NOT is_bridge)"
    return f"""graded AS (SELECT *, CASE WHEN t = '' OR NOT (is_bridge OR is_building) OR coalesce({road}, FALSE) THEN 0
        WHEN {_any(V.COLLAPSE)} THEN 3 WHEN {_any(V.PARTIAL)} THEN 2 WHEN {_any(V.CRACK)} THEN 1 ELSE 0 END AS thirds
        FROM (SELECT *, {_any(V.BRIDGE)} AS is_bridge, {_any(V.BUILDING)} OR coalesce({category} IN ('education', 'health'), FALSE) AS is_building
              FROM (SELECT *, lower(coalesce(raw_text, '')) AS t FROM grouped) a) b)"""


EMERGENCY = f"""{emergency_sql()},
em0 AS (SELECT group_id, max(thirds) AS thirds, count(DISTINCT CASE WHEN thirds > 0 THEN lower(trim(raw_text)) END) AS voices
        FROM graded GROUP BY group_id),
ph AS (SELECT g.group_id, max(CASE damage_grade WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 WHEN 'collapse' THEN 3 ELSE 0 END) AS p_thirds,
        arg_max(coalesce(damage_confidence, 0), struct_pack(g := CASE damage_grade WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 WHEN 'collapse' THEN 3 ELSE 0 END,
        c := coalesce(damage_confidence, 0), i := -attachment_id)) AS p_conf
        FROM photo_rows p JOIN grouped g ON g.id = p.report_id WHERE authenticity IS NOT NULL AND damage_grade <> '' AND damage_structure <> '' GROUP BY 1),
hz AS (SELECT c.group_id, coalesce(r.n, 0) AS river_warnings, coalesce(a.alerts, 0) AS alerts FROM centres c
  LEFT JOIN (SELECT c.group_id, count(*) AS n FROM centres c JOIN readings r ON {S.hav('c.lat', 'c.lon', 'r.p_lat', 'r.p_lon')} <= 25
             WHERE r.observed_at >= {AS_OF_SQL} - INTERVAL '72' HOUR GROUP BY 1) r USING (group_id)
  LEFT JOIN (SELECT c.group_id, a.alerts FROM centres c JOIN ALERTS_HERE a ON a.box_name = BOX_HERE) a USING (group_id)),
em1 AS (SELECT e.group_id, greatest(e.thirds, coalesce(p.p_thirds, 0)) AS top3, e.thirds, coalesce(p.p_thirds, 0) AS p3,
  CASE WHEN voices >= 2 THEN 0.5e0 WHEN voices = 1 THEN 0.4e0 ELSE 0e0 END AS wording,
  least(0.3e0, 0.3e0 * greatest(0e0, {S.VELOCITY.replace('{r}', 'coalesce(b.burst, 0)')})) AS burst_part,
  least(0.3e0, CASE WHEN h.alerts > 0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN h.river_warnings > 0 THEN 0.15e0 ELSE 0e0 END) AS hazard_part,
  least(0.4e0, 0.4e0 * coalesce(p.p_conf, 0)) AS photo_part
  FROM em0 e LEFT JOIN ph p USING (group_id) LEFT JOIN burst b USING (group_id) LEFT JOIN hz h USING (group_id)),
em AS (SELECT group_id, CASE WHEN top3 = 0 THEN 0e0 ELSE top3 / 3e0 END AS grade,
  CASE top3 WHEN 1 THEN 'crack' WHEN 2 THEN 'partial' WHEN 3 THEN 'collapse' END AS grade_label,
  CASE WHEN top3 = 0 THEN 0e0 ELSE {S.rnd('least(1e0, wording + burst_part + hazard_part + photo_part)', 4)} END AS grade_confidence FROM em1)"""


def emergency_ctes() -> str:
    from .spatial_queries import ACTIVE, BOX_OF

    return EMERGENCY.replace("ALERTS_HERE", ACTIVE).replace("BOX_HERE", BOX_OF)


def emergency_table(v):
    burst = cluster.burst_ratio(v.grouped, ["group_id"], AS_OF)
    hazard = hazards.hazards(v.centres, v.readings, v.alerts, AS_OF)
    member_photos = v.photo_rows.join(
        v.grouped.select(C("id").alias("report_id"), "group_id"), "report_id")
    return emergency.fuse(v.grouped, burst, hazard, photos.rollup(member_photos, ["group_id"]), ["group_id"])


@query("agg_19_emergency_fusion", "AGG-19", "group_id:i grade:d grade_label:s grade_confidence:d urgency:d",
       f"WITH {BURST}, {emergency_ctes()} SELECT *, {S.URGENCY} AS urgency FROM em",
       "grouped centres readings alerts photo_rows")
def emergency_fusion(v):
    return emergency_table(v)


@query("agg_23_village_money", "AGG-23", "place_id:i undelivered_cost:d oldest_year:i unspent_rupees:d",
       f"""SELECT p.id AS place_id, w.cost AS undelivered_cost, w.oldest AS oldest_year, f.unspent AS unspent_rupees FROM places p
           LEFT JOIN (SELECT place_id, coalesce(sum(coalesce(cost_lakh, 0)) FILTER (status IN {OPEN}), 0) AS cost,
             min(sanction_year) FILTER (status IN {OPEN}) AS oldest FROM works WHERE place_id IS NOT NULL GROUP BY 1) w ON w.place_id = p.id
           LEFT JOIN (SELECT place_id, {S.rnd('coalesce(untied_receipts, 0) - coalesce(untied_payments, 0) + coalesce(tied_receipts, 0) - coalesce(tied_payments, 0)', 2)} AS unspent
             FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY fin_year DESC, id DESC) AS rn FROM finance) WHERE rn = 1) f
             ON f.place_id = p.id""", "places works finance")
def village_money(v):
    from ..plans.invest import unspent_by_place

    w = K.works_by_place(v.works).select("place_id", C("undelivered_cost"), "oldest_year")
    return v.places.select(C("id").alias("place_id")).join(w, "place_id", "left").join(
        unspent_by_place(v.finance), "place_id", "left")


@query("agg_25_quality_summary", "AGG-25",
       "reports:i with_category:i with_point:i with_village:i resolved_pct:d mean_teachers:d major_repair_pct:d",
       f"""SELECT r.*, s.* FROM (SELECT count(*) AS reports, count(issue_category) AS with_category, count(lat) AS with_point,
             count(village) AS with_village, {S.rnd('100e0 * count(village) / count(*)', 2)} AS resolved_pct FROM located) r,
           (SELECT {S.rnd('avg(coalesce(teachers_regular, 0) + coalesce(teachers_contract, 0))', 2)} AS mean_teachers,
             {S.rnd('100e0 * count(*) FILTER (classrooms_major_repair > 0) / count(*)', 2)} AS major_repair_pct FROM school_rows WHERE NOT fetch_failed) s""",
       "located school_rows")
def quality(v):
    from ..plans.recompute import report_quality, school_quality

    return report_quality(v.located).join(school_quality(v.school_rows), "one").drop("one")


@query("agg_25_status_spread", "AGG-25", "status:s works:i matched:i matched_pct:d",
       f"""SELECT status, count(*) AS works, count(place_id) AS matched, {S.rnd('100e0 * count(place_id) / count(*)', 2)} AS matched_pct
           FROM works GROUP BY status""", "works")
def status_spread(v):
    from ..plans.recompute import works_quality

    return works_quality(v.works)


@query("agg_26_run_summary", "AGG-26", "reports_total:i reports_clustered:i clusters:i categories:s top_reports:i",
       """SELECT (SELECT count(*) FROM located) AS reports_total, (SELECT count(*) FROM grouped) AS reports_clustered, sum(n) AS clusters,
          string_agg(category || '=' || cast(n AS VARCHAR), ',' ORDER BY category) AS categories, max(top) AS top_reports
          FROM (SELECT category, count(*) AS n, max(report_count) AS top FROM centres GROUP BY category) x""", "located grouped centres")
def run_summary(v):
    from ..functions.nested import map_text
    from ..plans.recompute import summary

    scored = v.centres.withColumn("priority_score", C("report_count"))
    out = summary(v.located, v.grouped.select("id"), scored)
    return out.select(
        "reports_total", "reports_clustered", "clusters", map_text(C("categories")).alias("categories"),
        C("top_score").alias("top_reports"))


@query("agg_27_classifier_scores", "AGG-27", "n:i accuracy:d precision:d recall:d f1:d roc_auc:d tp:i fp:i tn:i fn:i",
       f"""WITH s AS (SELECT l.quality AS y, (d.n_chars % 97) / 97e0 AS score FROM labels l JOIN documents d USING (doc_id)),
           a AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND score >= 0.25e0) AS tp, count(*) FILTER (y = 0 AND score >= 0.25e0) AS fp,
                 count(*) FILTER (y = 0 AND score < 0.25e0) AS tn, count(*) FILTER (y = 1 AND score < 0.25e0) AS fn FROM s),
           p AS (SELECT avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END) AS auc
                 FROM s a JOIN s b ON a.y = 1 AND b.y = 0)
           SELECT n, {S.rnd('(tp + tn) / (n * 1e0)', 4)} AS accuracy, {S.rnd('tp / (tp + fp * 1e0)', 4)} AS precision, {S.rnd('tp / (tp + fn * 1e0)', 4)} AS recall,
             {S.rnd('2e0 * tp / (2e0 * tp + fp + fn)', 4)} AS f1, {S.rnd('auc', 4)} AS roc_auc, tp, fp, tn, fn FROM a, p""")
def classifier(v):
    scored = v.labels.join(v.documents.select("doc_id", "n_chars"), "doc_id").select(
        C("quality").alias("label"), ((C("n_chars") % 97) / 97.0).alias("score"))
    return photos.classifier_scores(scored, DEFAULTS.defect_threshold)


@query("agg_28_district_rollup", "AGG-28", "district:s clusters:i people:i districts:i",
       """SELECT district, count(*) AS clusters, sum(people) AS people, (SELECT count(DISTINCT district) FROM (
            SELECT p.district FROM places p)) AS districts FROM (
          SELECT p.district, coalesce(p.population, 0) AS people FROM places p) x GROUP BY district""", "places")
def district_rollup(v):
    from ..plans.views import district_rollup as roll

    return roll(v.places.select("district", F.coalesce("population", F.lit(0)).alias("population_affected")))


@query("agg_29_scale_anchors", "AGG-29", "low:d upper:d high:d max_people:i",
       """SELECT min(confidence) AS low, quantile_cont(confidence, 0.6) AS upper, max(confidence) AS high, max(place_id) AS max_people
          FROM located""", "located")
def anchors(v):
    from ..plans.views import scale_anchors

    return scale_anchors(v.located.select(
        C("confidence").alias("priority_score"), C("place_id").alias("population_affected")))
