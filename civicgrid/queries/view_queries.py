"""Windows, sorts, sets, read views, text to structured rows, cautions."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text
from ..functions.numeric import TERMS
from ..operators import cluster, lookup
from ..operators.catchment import top_array, works_by_place
from ..plans import cautions, evidence, repair, sampling, score, structure, views, villages
from . import sqltext as S
from .aggregate_queries import FACTS, SCHOOLS, facts
from .plan_queries import GIVEN_SQL, VILLAGES, VILLAGE_VIEWS, given_assets, given_villages, registers
from .registry import query, register
from .text_queries import _conf_sql, cat_sql, lang_sql, lit, sev_sql
from .views import AS_OF

C = F.col

# ---- WIN

register("win_01_rank_in_district", "WIN-01", "place_id:i rank_in_district:i", given_villages,
         f"WITH {VILLAGES} SELECT place_id, rank_in_district FROM vill", VILLAGE_VIEWS)


@query("win_02_runner_up", "WIN-02", "cluster_id:i rank:i runner_up_cluster_id:i",
       """SELECT cluster_id, row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS rank,
          lead(cluster_id) OVER (ORDER BY priority_score DESC, cluster_id) AS runner_up_cluster_id FROM clusters""", "clusters")
def runner_up(v):
    from ..plans.recompute import rank_clusters

    return rank_clusters(v.clusters.withColumnRenamed("cluster_id", "group_id")).withColumnRenamed("group_id", "cluster_id")


@query("win_03_overall_rank", "WIN-03", "cluster_id:i rank:i ranked_out_of:i",
       "SELECT cluster_id, row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS rank, count(*) OVER () AS ranked_out_of FROM clusters",
       "clusters")
def overall_rank(v):
    return views.ranked(v.clusters)


@query("win_04_latest_records", "WIN-04", "place_id:i fin_year:s finance_id:i samples:i",
       """SELECT f.place_id, f.fin_year, f.id AS finance_id, t.samples FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY fin_year DESC, id DESC) AS rn FROM finance) f
          LEFT JOIN (SELECT place_id, arg_max(coalesce(samples_tested, 0), id) AS samples FROM water_tests GROUP BY 1) t ON t.place_id = f.place_id WHERE rn = 1""",
       "finance water_tests")
def latest_records(v):
    from ..operators.catchment import tests_by_place

    last = lookup.latest_by(v.finance, ["place_id"], ["fin_year", "id"])
    return last.join(tests_by_place(v.water_tests), "place_id", "left").withColumnRenamed("id", "finance_id")


_READ = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS station, l_shipdate AS ts, CASE WHEN l_orderkey % 17 = 0 THEN 0e0 ELSE -l_quantity / 7e0 END AS level FROM {lineitem}"


@query("win_05_station_trend", "WIN-05", "station:i level:d previous:d trend:s",
       f"""SELECT station, level, previous, CASE WHEN previous IS NULL THEN 'stable' WHEN level - previous < -0.05e0 THEN 'falling' WHEN level - previous > 0.05e0 THEN 'rising' ELSE 'stable' END AS trend
           FROM (SELECT *, lag(level) OVER (PARTITION BY station ORDER BY ts, id) AS previous, row_number() OVER (PARTITION BY station ORDER BY ts DESC, id DESC) AS rn
                 FROM ({_READ.format(lineitem='lineitem')}) q WHERE level <> 0) x WHERE rn = 1""")
def station_trend(v):
    from ..sources.stations import last_two

    return last_two(v.sql(_READ), "station", ["ts", "id"], "level")


def owned(v):
    return v.located.join(v.grouped.select("id", C("group_id").alias("asset_id")), "id", "left")


@query("win_06_asset_rank", "WIN-06", "place_id:i asset_id:i rank_in_village:i",
       f"""WITH ga AS ({GIVEN_SQL}) SELECT place_id, asset_id, row_number() OVER (PARTITION BY place_id ORDER BY priority_score DESC, asset_id) AS rank_in_village
           FROM (SELECT DISTINCT place_id, group_id AS asset_id FROM grouped) p JOIN ga USING (asset_id)""", "grouped centres")
def asset_rank(v):
    return views.asset_rank(owned(v), given_assets(v))


@query("win_07_name_suffix", "WIN-07", "segment_id:i shown:s",
       """SELECT segment_id, CASE WHEN n = 1 THEN nm ELSE nm || ' #' || cast(n AS VARCHAR) END AS shown FROM (
          SELECT segment_id, trim(road_name) AS nm, row_number() OVER (PARTITION BY trim(road_name) ORDER BY segment_id) AS n FROM segments) x""", "segments")
def suffix(v):
    return cluster.numbered_names(v.segments.select("segment_id", F.trim("road_name").alias("name")), "name", "segment_id")


@query("win_08_first_seen", "WIN-08", "group_id:i voices:i first_ids:i",
       """SELECT group_id, count(*) AS voices, sum(first_id) AS first_ids FROM (SELECT group_id, lower(trim(coalesce(raw_text, ''))) AS w,
          arg_min(id, struct_pack(t := created_at, i := id)) AS first_id FROM grouped GROUP BY 1, 2) x GROUP BY group_id""", "grouped")
def first_seen(v):
    first = cluster.first_seen(v.grouped, ["group_id"])
    return first.groupBy("group_id").agg(F.count(F.lit(1)).alias("voices"), F.sum("id").alias("first_ids"))


register("win_09_top_and_urgent", "WIN-09", "place_id:i top_asset_id:i urgent_asset_id:i urgent_grade_label:s", given_villages,
         f"WITH {VILLAGES} SELECT place_id, top_asset_id, urgent_asset_id, urgent_grade_label FROM vill", VILLAGE_VIEWS)

_LONG = " UNION ALL ".join(f"SELECT cluster_id, '{t}' AS term, {t} AS points FROM clusters" for t in TERMS)
NEXT = "nx AS (SELECT cluster_id, lead(cluster_id) OVER (ORDER BY priority_score DESC, cluster_id) AS other_id FROM clusters)"


@query("win_10_term_lead", "WIN-10", "cluster_id:i other_id:i term:s lead:d nth:i",
       f"""WITH {NEXT}, lg AS ({_LONG}), d AS (SELECT nx.cluster_id, nx.other_id, a.term, a.points - b.points AS lead FROM nx JOIN lg a ON a.cluster_id = nx.cluster_id
           JOIN lg b ON b.cluster_id = nx.other_id AND b.term = a.term)
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, other_id ORDER BY lead DESC, term) AS nth FROM d WHERE lead > 0.3e0) x WHERE nth <= 3""", "clusters")
def term_lead(v):
    from ..plans.recompute import rank_clusters

    nxt = rank_clusters(v.clusters.withColumnRenamed("cluster_id", "group_id")).select(
        C("group_id").alias("cluster_id"), C("runner_up_cluster_id").alias("other_id")).filter("other_id is not null")
    return views.term_lead(v.clusters, nxt)


@query("win_10_compare", "WIN-10", "cluster_id:i other_id:i need_over_volume:b",
       f"""WITH {NEXT}, p AS (SELECT other_id AS a, cluster_id AS b FROM nx WHERE other_id IS NOT NULL)
           SELECT CASE WHEN x.priority_score >= y.priority_score THEN a ELSE b END AS cluster_id, CASE WHEN x.priority_score >= y.priority_score THEN b ELSE a END AS other_id,
             CASE WHEN x.priority_score >= y.priority_score THEN y.report_count > x.report_count ELSE x.report_count > y.report_count END AS need_over_volume
           FROM p JOIN clusters x ON x.cluster_id = p.a JOIN clusters y ON y.cluster_id = p.b""", "clusters")
def compare(v):
    from ..plans.recompute import rank_clusters

    pairs = rank_clusters(v.clusters.withColumnRenamed("cluster_id", "group_id")).filter("runner_up_cluster_id is not null").select(
        C("runner_up_cluster_id").alias("a"), C("group_id").alias("b"))
    return views.compare(v.clusters, pairs)


# ---- SRT

_SCORES = "SELECT group_id AS cluster_id, id AS score_id, confidence AS priority_score FROM {grouped} WHERE confidence IS NOT NULL AND issue_category <> 'water'"


@query("srt_01_score_order", "SRT-01", "position:i cluster_id:i priority_score:d",
       f"""SELECT c.group_id AS cluster_id, s.score AS priority_score, row_number() OVER (ORDER BY s.score DESC NULLS LAST, c.group_id) AS position FROM centres c LEFT JOIN
           (SELECT cluster_id, arg_max(priority_score, score_id) AS score FROM ({_SCORES.format(grouped='grouped')}) q GROUP BY 1) s ON s.cluster_id = c.group_id""",
       "centres grouped")
def score_order(v):
    return views.cluster_list(v.centres.select(C("group_id").alias("cluster_id")), v.sql(_SCORES))


register("srt_02_page", "SRT-02", "id:i village:s",
         lambda v: v.located.orderBy("id").offset(40).limit(50).select("id", "village"),
         "SELECT id, village FROM located ORDER BY id LIMIT 50 OFFSET 40", "located")


@query("srt_03_null_distance_last", "SRT-03", "district:s position:i place_id:i",
       """SELECT district, position, place_id FROM (SELECT district, id AS place_id, row_number() OVER (PARTITION BY district ORDER BY population IS NULL, population, name, id) AS position FROM places) x""",
       "places")
def null_last(v):
    return views.ordered_within(
        v.places.withColumnRenamed("id", "place_id"), "district", [C("population").asc_nulls_last(), C("name"), C("place_id")])


@query("srt_04_top_assets", "SRT-04", "district:s top_three:s",
       """SELECT district, string_agg(cast(cluster_id AS VARCHAR), ',' ORDER BY priority_score DESC, cluster_id) AS top_three FROM (SELECT *, row_number() OVER
          (PARTITION BY district ORDER BY priority_score DESC, cluster_id) AS rn FROM clusters) x WHERE rn <= 3 GROUP BY district""", "clusters")
def top_assets(v):
    out = top_array(v.clusters, "district", [C("priority_score").desc(), C("cluster_id")], C("cluster_id").cast("string"), 3, "t")
    return out.select("district", F.array_join("t", ",").alias("top_three"))


# ---- SET

@query("set_01_register_union", "SET-01", "category:s source:s n:i places:i",
       """SELECT category, source, count(*) AS n, count(DISTINCT village) AS places FROM facilities GROUP BY 1, 2""", "facilities")
def register_union(v):
    schools = v.facilities.filter("category = 'education'").drop("management")
    health = v.facilities.filter("category = 'health'")
    both = schools.unionByName(health, allowMissingColumns=True)
    return both.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("village").alias("places"))


register("set_02_distinct_blocks", "SET-02", "district:s block:s",
         lambda v: v.places.select("district", "block").distinct(), "SELECT DISTINCT district, block FROM places", "places")
register("set_03_difference", "SET-03", "id:i",
         lambda v: v.located.select("id").exceptAll(v.grouped.select("id")),
         "SELECT id FROM located EXCEPT ALL SELECT id FROM grouped", "located grouped")

# ---- PIP-01, 02, 16

_RAW = """SELECT e.event_id AS id, r.raw_text, r.district, e.event_id % 9 AS duplicate_count FROM {events} e JOIN {reports} r ON r.id = e.event_id"""


@query("pip_01_structure_reports", "PIP-01", "id:i language:s issue_category:s severity:s location_raw:s place_id:i confidence:d")
def structured(v):
    return structure.structure_reports(v.sql(_RAW), v.places)


@query("pip_01_text_fields", "PIP-01", "id:i language:s severity:s",
       f"""SELECT id, {lang_sql('trim(raw_text)')} AS language, CASE WHEN trim(raw_text) = '' THEN 'medium' ELSE {sev_sql('raw_text', 'duplicate_count')} END AS severity
           FROM ({_RAW.format(events='events', reports='reports')}) q""", "reports")
def text_fields(v):
    return structure.structure_columns(v.sql(_RAW))


FORMS = """SELECT r.id, r.raw_text, 'en' AS language, CASE WHEN r.id % 3 = 0 THEN NULL ELSE r.issue_category END AS issue_category, coalesce(r.severity, 'medium') AS severity,
  'somewhere' AS location_raw, 'D0' AS district, 'B0' AS block, 'V0' AS village, 1e0 AS latitude, 2e0 AS longitude,
  CASE WHEN r.id % 4 = 0 THEN NULL ELSE r.district END AS picked_district, r.block AS picked_block, p.name AS picked_village,
  CASE r.id % 5 WHEN 0 THEN 'pwd' WHEN 1 THEN 'mjp' WHEN 2 THEN 'dho' WHEN 3 THEN 'deo' ELSE NULL END AS department,
  cast(r.precise_lat AS STRING) AS report_lat, cast(r.precise_lon AS STRING) AS report_lon, r.facility_id, coalesce(r.confidence, 0.5e0) AS confidence,
  'Citizen ' || cast(r.id AS STRING) AS full_name, 'female' AS gender, '98' || cast(10000000 + r.id AS STRING) AS mobile, 'a@b.example' AS email,
  'Lane 1' AS address, '416001' AS pincode FROM {reports} r JOIN {places} p ON p.id = r.place_id"""
_SELF = text.self_naming("[A-Z][a-zA-Z]*", r"\b", r"\b")
_RED = (f"regexp_replace(regexp_replace(regexp_replace(trim(raw_text), {lit(V.PHONE)}, '[PHONE]', 'g'), {lit(V.TITLED_NAME)}, '[NAME]', 'g'), {lit(_SELF)}, '\\1\\2\\3 [NAME]', 'g')")


@query("pip_02_intake_resolution", "PIP-02",
       "id:i raw_text:s issue_category:s district:s village:s location_raw:s latitude:d precise_lat:d pin_source:s facility_id:i confidence:d",
       f"""WITH fm AS ({FORMS.format(reports='reports', places='places')}),
           pt AS (SELECT district AS d, block AS b, name AS n, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM places GROUP BY 1, 2, 3),
           t AS (SELECT fm.*, pt.lat IS NOT NULL AS picked, coalesce(pt.lat, latitude) AS vlat, coalesce(pt.lon, longitude) AS vlon,
                 try_cast(report_lat AS DOUBLE) AS plat, try_cast(report_lon AS DOUBLE) AS plon FROM fm LEFT JOIN pt ON pt.d = picked_district AND pt.b = picked_block AND pt.n = picked_village),
           u AS (SELECT *, picked AND plat IS NOT NULL AND plon IS NOT NULL AND {S.hav('plat', 'plon', 'vlat', 'vlon')} <= 5 AS pin,
                 coalesce(issue_category, CASE WHEN picked THEN CASE department WHEN 'pwd' THEN 'road' WHEN 'mjp' THEN 'water' WHEN 'dho' THEN 'health' WHEN 'deo' THEN 'education' END END) AS cat FROM t)
           SELECT u.id, {_RED} AS raw_text, cat AS issue_category, CASE WHEN picked THEN picked_district ELSE u.district END AS district,
             CASE WHEN picked THEN picked_village ELSE u.village END AS village, CASE WHEN picked THEN picked_village ELSE location_raw END AS location_raw, vlat AS latitude,
             CASE WHEN pin THEN plat END AS precise_lat, CASE WHEN pin THEN 'citizen_gps' END AS pin_source,
             CASE WHEN picked AND f.category = cat AND {S.hav('vlat', 'vlon', 'f.p_lat', 'f.p_lon')} <= 10 THEN f.id END AS facility_id,
             CASE WHEN picked THEN {S.rnd('least(1e0, confidence + (1 - confidence) * 0.5e0)', 2)} ELSE confidence END AS confidence
           FROM u LEFT JOIN facilities f ON f.id = u.facility_id""", "reports places facilities")
def intake(v):
    return structure.resolve_intake(v.sql(FORMS), v.places, v.facilities)


@query("pip_02_identity_apart", "PIP-02", "linked_request_id:i full_name:s mobile:s original_text:s",
       f"SELECT id AS linked_request_id, full_name, mobile, raw_text AS original_text FROM ({FORMS.format(reports='reports', places='places')}) q", "reports places")
def identity(v):
    return structure.identity_rows(v.sql(FORMS))


@query("pip_16_repair", "PIP-16", "id:i village:s issue_category:s latitude:d")
def repaired(v):
    hq = v.places.filter("admin_level = 'block'").select("id", "name", "district", "lat", "lon")
    rep = v.reports.withColumn("duplicate_count", F.lit(0)).withColumn(
        "latitude", F.when(C("id") % 3 != 0, C("latitude")))
    return repair.repair(v.places, hq, rep)[1]


# ---- PIP-18, 19, TXT-13

_CAUTION = """CASE WHEN f THEN 'already_funded' WHEN need AND NOT (category = 'water' AND schemes_found > 0) THEN 'unfunded_need' END"""


@query("pip_18_funding_cautions", "PIP-18", "group_id:i caution:s caution_text:s",
       f"""WITH {FACTS}, t AS (SELECT *, CASE category WHEN 'road' THEN undelivered_works > 0 WHEN 'water' THEN schemes_found > 0 AND undelivered_schemes > 0 ELSE FALSE END AS f,
             records > 0 AND CASE category WHEN 'road' THEN coalesce(no_all_weather > 0 OR no_black_top > 0, FALSE) WHEN 'water' THEN CASE WHEN tap_villages > 0 THEN
             {S.rnd('100 * CASE WHEN tap_households > 0 THEN tap_weighted / tap_households ELSE tap_mean / 100 END', 1)} < 100 ELSE coalesce(no_treated > 0 OR fails_summer > 0, FALSE) END ELSE FALSE END AS need FROM facts)
           SELECT group_id, {_CAUTION} AS caution, CASE ({_CAUTION}) WHEN 'already_funded' THEN CASE category WHEN 'road' THEN
             concat_ws(' - ', cast(undelivered_works AS VARCHAR) || ' sanctioned PMGSY ' || CASE WHEN undelivered_works = 1 THEN 'work near this cluster is' ELSE 'works near this cluster are' END || ' recorded as still undelivered',
               CASE WHEN undelivered_cost_lakh > 0 THEN 'Rs ' || format('{{:,.2f}}', undelivered_cost_lakh) || ' lakh already committed' END,
               'oldest sanctioned in ' || cast(oldest_undelivered_year AS VARCHAR)) || '. Check delivery of the existing sanction before recommending new money.'
             ELSE concat_ws(' - ', cast(undelivered_schemes AS VARCHAR) || ' JJM water ' || CASE WHEN undelivered_schemes = 1 THEN 'scheme near this cluster is' ELSE 'schemes near this cluster are' END || ' recorded as still ongoing',
               CASE WHEN unspent_estimate_lakh > 0 THEN 'Rs ' || format('{{:,.2f}}', unspent_estimate_lakh) || ' lakh of the estimated cost still unspent' END)
               || '. Check delivery of the existing scheme before recommending new money.' END
             WHEN 'unfunded_need' THEN CASE category WHEN 'road' THEN 'No PMGSY-sanctioned work is recorded near this cluster despite a documented road deficiency here — this need currently has no funding attached.'
             ELSE 'No JJM scheme record is found near this cluster despite a documented water deficiency here — this need currently has no funding attached.' END END AS caution_text FROM t""",
       "centres village_records works schemes water_tests employment")
def funding(v):
    return cautions.funding_cautions(facts(v))


@query("pip_19_weighted_pick", "PIP-19", "draw_id:i item_id:i",
       """WITH it AS (SELECT id AS item_id, CASE WHEN population > 0 THEN population * 1e0 ELSE 50e0 END AS w FROM places),
          cu AS (SELECT item_id, (sum(w) OVER (ORDER BY item_id) - w) / (SELECT sum(w) FROM it) AS lo, sum(w) OVER (ORDER BY item_id) / (SELECT sum(w) FROM it) AS hi FROM it)
          SELECT event_id AS draw_id, item_id FROM events JOIN cu ON (event_id * 7919 % 100003) / 100003e0 >= lo AND (event_id * 7919 % 100003) / 100003e0 < hi""", "places")
def pick(v):
    draws = v.events.select(C("event_id").alias("draw_id"), (C("event_id") * 7919 % 100003 / 100003.0).alias("u"))
    return sampling.weighted_pick(draws, v.places.select(C("id").alias("item_id"), C("population").alias("weight")))


@query("txt_13_catchment_sentences", "TXT-13", "group_id:i schemes:s water_tests:s employment:s",
       f"""WITH {FACTS} SELECT group_id, CASE WHEN schemes_found > 0 AND undelivered_schemes = 0 THEN cast(schemes_found AS VARCHAR) || ' real JJM scheme(s) found in this catchment, all completed'
             WHEN schemes_found > 0 THEN cast(undelivered_schemes AS VARCHAR) || ' of ' || cast(schemes_found AS VARCHAR) || ' real JJM scheme(s) in this catchment still ongoing, ₹' || cast(unspent_estimate_lakh AS VARCHAR) || ' lakh of the estimated cost unspent' END AS schemes,
             CASE WHEN villages_tested > 0 THEN cast(villages_tested AS VARCHAR) || ' of ' || cast(villages AS VARCHAR) || ' catchment villages tested this year (JJM WQMIS, current cycle): ' || cast(samples_total AS VARCHAR) || ' samples total' END AS water_tests,
             CASE WHEN job_villages > 0 THEN cast(job_villages AS VARCHAR) || ' of ' || cast(villages AS VARCHAR) || ' catchment villages have a real MGNREGA record (' || split_part(job_years, ',', -1) || '): Rs ' || format('{{:,.2f}}', job_total_lakh)
               || ' lakh total expenditure (Rs ' || format('{{:,.2f}}', job_wages_lakh) || ' lakh wages, Rs ' || format('{{:,.2f}}', job_material_lakh) || ' lakh material)' END AS employment FROM facts""",
       "centres village_records works schemes water_tests employment")
def sentences(v):
    return facts(v).select(
        "group_id", evidence.scheme_sentence().alias("schemes"), evidence.water_test_sentence().alias("water_tests"),
        evidence.employment_catchment_sentence().alias("employment"))


def _ru(x: str) -> str:
    return "'₹' || format('{:,.0f}', CAST(" + x + " AS DOUBLE))"


_FIN_SQL = f"""SELECT place_id, 'FY ' || fin_year || ': untied grant ' || coalesce({_ru('untied_receipts')}, '₹0') || ' received, ' || coalesce({_ru('untied_payments')}, '₹0') || ' spent'
  || coalesce(CASE WHEN untied_receipts > 0 THEN ' (' || format('{{:.0f}}', least(100e0, untied_payments / untied_receipts * 100)) || '% utilised)' END, '')
  || '; tied grant ' || coalesce({_ru('tied_receipts')}, '₹0') || ' received, ' || coalesce({_ru('tied_payments')}, '₹0') || ' spent.' AS finance
  FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY fin_year DESC, id DESC) AS rn FROM finance) WHERE rn = 1"""
_JOB_SQL = """SELECT place_id, 'FY ' || fin_year || ': ' || coalesce('MGNREGA expenditure ₹' || format('{:,.2f}', total_lakh) || ' lakh', '') || ' (wages ₹' || format('{:,.2f}', wages_lakh)
  || ' lakh [60%], material ₹' || format('{:,.2f}', material_lakh) || ' lakh [40%]).' AS employment
  FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY fin_year DESC, id DESC) AS rn FROM employment) WHERE rn = 1"""


@query("txt_13_record_sentences", "TXT-13", "place_id:i finance:s employment:s",
       f"SELECT coalesce(f.place_id, j.place_id) AS place_id, f.finance, j.employment FROM ({_FIN_SQL}) f FULL JOIN ({_JOB_SQL}) j ON j.place_id = f.place_id",
       "finance employment")
def record_sentences(v):
    fin = lookup.latest_by(v.finance, ["place_id"], ["fin_year", "id"]).select("place_id", evidence.finance_sentence().alias("finance"))
    job = lookup.latest_by(v.employment, ["place_id"], ["fin_year", "id"]).withColumns({
        "wages_percent": F.lit(60.0), "material_percent": F.lit(40.0)}).select("place_id", evidence.employment_sentence().alias("employment"))
    return fin.join(job, "place_id", "full")


@query("txt_13_school_sentences", "TXT-13", "facility_id:i sentence:s",
       f"""WITH {SCHOOLS} SELECT facility_id, concat_ws('; ',
             CASE WHEN teachers_regular IS NOT NULL OR teachers_contract IS NOT NULL THEN cast(coalesce(teachers_regular, 0) + coalesce(teachers_contract, 0) AS VARCHAR)
               || CASE WHEN coalesce(teachers_regular, 0) + coalesce(teachers_contract, 0) = 1 THEN ' teacher' ELSE ' teachers' END || ' (2023-24)' END,
             concat_ws(', ', cast(classrooms_total - classrooms_major_repair AS VARCHAR) || ' of ' || cast(classrooms_total AS VARCHAR) || ' classrooms good',
               CASE WHEN classrooms_major_repair > 0 THEN cast(classrooms_major_repair AS VARCHAR) || CASE WHEN classrooms_major_repair = 1 THEN ' needs' ELSE ' need' END || ' major repair' END),
             nullif(concat_ws(', ', 'grant ' || {_ru('total_grant')}, 'spent ' || {_ru('total_expenditure')}), '')) || '.' AS sentence FROM schools""", "school_rows")
def school_sentences(v):
    from ..operators.catchment import latest_school_rows

    rows = latest_school_rows(v.school_rows).withColumns({
        "teachers_part_time": F.lit(None).cast("int"), "classrooms_good": C("classrooms_total") - C("classrooms_major_repair"),
        "classrooms_minor_repair": F.lit(None).cast("int")})
    return rows.select("facility_id", evidence.school_sentence().alias("sentence"))


# ---- VW

@query("vw_01_ranked_clusters", "VW-01", "position:i cluster_id:i issue_category:s priority_score:d runner_up_cluster_id:i",
       """SELECT row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS position, cluster_id, issue_category, priority_score,
          lead(cluster_id) OVER (ORDER BY priority_score DESC, cluster_id) AS runner_up_cluster_id FROM clusters""", "clusters")
def ranked_list(v):
    scores = v.clusters.select("cluster_id", F.lit(1).alias("score_id"), "priority_score")
    return views.cluster_list(v.clusters.drop("priority_score"), scores)


@query("vw_02_cluster_detail", "VW-02", "cluster_id:i category:s priority_score:d caution:s groups:i first_label:s people:i")
def cluster_detail(v):
    from ..config import DEFAULTS

    scored = cautions.funding_cautions(score.score_groups(v.grouped, v.centres, registers(v), AS_OF))
    members = v.grouped.join(cluster.work_groups(v.grouped, "group_id", DEFAULTS.work_group_m).select("id", "root"), "id")
    wg = cluster.describe_work_groups(members, "group_id").withColumn("gid", C("root")).join(
        v.centres.select("group_id", "category"), "group_id")
    wg = cluster.name_work_groups(wg, "category", v.facilities, cluster.works_by_village(v.works, v.places))
    out = views.cluster_detail(
        scored.select(C("group_id").alias("cluster_id"), "category", "priority_score", "caution",
                      score.breakdown_struct(), score.evidence_struct()),
        wg.withColumnRenamed("group_id", "cluster_id"))
    return out.withColumns({
        "groups": F.size("work_groups"), "first_label": C("work_groups")[0]["label"],
        "people": C("evidence.population.people_affected")})


@query("vw_03_cluster_reports", "VW-03", "cluster_id:i position:i id:i report_count:i distinct_texts:i photos:i",
       """SELECT * FROM (SELECT g.group_id AS cluster_id, g.id, row_number() OVER (PARTITION BY g.group_id ORDER BY created_at DESC, g.id DESC) AS position,
          count(*) OVER (PARTITION BY g.group_id) AS report_count, t.distinct_texts, coalesce(p.n, 0) AS photos FROM grouped g
          JOIN (SELECT group_id, count(DISTINCT CASE WHEN user_id IS NOT NULL THEN 'account:' || user_id ELSE 'text:' || lower(trim(coalesce(raw_text, ''))) END) AS distinct_texts FROM grouped GROUP BY 1) t USING (group_id)
          LEFT JOIN (SELECT report_id, count(*) AS n FROM photo_rows GROUP BY 1) p ON p.report_id = g.id) x WHERE position <= 200""", "grouped photo_rows")
def cluster_reports(v):
    kids = v.photo_rows.groupBy(C("report_id").alias("id")).agg(F.count(F.lit(1)).alias("photos"))
    out = views.cluster_reports(v.grouped.withColumnRenamed("group_id", "cluster_id"), kids)
    return out.withColumn("photos", F.coalesce("photos", F.lit(0)))


_STATUS = """SELECT l.id, CASE WHEN l.village IS NULL THEN 'unresolved' WHEN k.cluster_id IS NULL THEN 'awaiting_corroboration' ELSE 'clustered' END AS status,
  CASE WHEN l.village IS NOT NULL THEN k.rank END AS rank, l.user_id FROM located l LEFT JOIN grouped g ON g.id = l.id AND g.id % 7 <> 0
  LEFT JOIN (SELECT cluster_id, row_number() OVER (ORDER BY priority_score DESC, cluster_id) AS rank FROM clusters) k ON k.cluster_id = g.group_id"""


def with_cluster(v):
    return cluster.assign(v.located, v.grouped.filter("id % 7 <> 0").select("id", C("group_id").alias("cluster_id")))


register("vw_04_report_status", "VW-04", "id:i status:s rank:i",
         lambda v: views.report_status(with_cluster(v), views.ranked(v.clusters)), _STATUS, "located grouped clusters")


@query("vw_05_map_layer", "VW-05", "cluster_id:i priority_score:d has_feature:b",
       "SELECT cluster_id, priority_score, TRUE AS has_feature FROM clusters WHERE centroid_lat IS NOT NULL", "clusters")
def map_layer(v):
    out = views.geojson_features(v.clusters, "centroid_lat", "centroid_lon", ["cluster_id", "issue_category", "priority_score"])
    ok = (F.get_json_object("feature", "$.geometry.type") == "Point") & F.get_json_object(
        "feature", "$.geometry.coordinates[1]").isNotNull()
    return out.withColumn("has_feature", ok)


@query("vw_06_village_list", "VW-06", "place_id:i rank_in_district:i priority_score:d top_name:s urgent_name:s has_urgent_asset:b",
       f"""WITH {VILLAGES} SELECT place_id, rank_in_district, priority_score, 'Asset ' || cast(top_asset_id AS VARCHAR) AS top_name,
           'Asset ' || cast(urgent_asset_id AS VARCHAR) AS urgent_name, urgent_asset_id IS NOT NULL AS has_urgent_asset FROM vill""", VILLAGE_VIEWS)
def village_list(v):
    named = given_assets(v).withColumns({
        "name": F.concat(F.lit("Asset "), C("asset_id").cast("string")), "asset_type": F.lit("road")})
    return views.village_list(given_villages(v), named)


@query("vw_07_village_detail", "VW-07", "place_id:i asset_id:i rank_in_village:i village_reports:i lat:d",
       f"""WITH ga AS (SELECT a.*, c.lat, c.lon FROM ({GIVEN_SQL}) a JOIN centres c ON c.group_id = a.asset_id)
           SELECT place_id, asset_id, row_number() OVER (PARTITION BY place_id ORDER BY priority_score DESC, asset_id) AS rank_in_village, n AS village_reports, {S.rnd('lat', 3)} AS lat
           FROM (SELECT place_id, group_id AS asset_id, count(*) AS n FROM grouped GROUP BY 1, 2) p JOIN ga USING (asset_id)""", "grouped centres")
def village_detail(v):
    a = given_assets(v).join(v.centres.select(C("group_id").alias("asset_id"), "lat", "lon"), "asset_id").withColumn(
        "location_basis", F.lit("mixed"))
    return views.village_detail(owned(v), a)


@query("vw_08_asset_detail", "VW-08", "place_id:i asset_id:i rank_in_village:i photos:i worst:s",
       f"""WITH ga AS ({GIVEN_SQL}), ph AS (SELECT g.group_id AS asset_id, count(*) AS photos, arg_max(damage_grade, struct_pack(
             g := CASE damage_grade WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END, c := coalesce(damage_confidence, 0), i := -attachment_id))
             FILTER (authenticity IS NOT NULL AND damage_grade <> '' AND damage_structure <> '') AS worst FROM photo_rows p JOIN grouped g ON g.id = p.report_id GROUP BY 1)
           SELECT place_id, p.asset_id, row_number() OVER (PARTITION BY place_id ORDER BY priority_score DESC, p.asset_id) AS rank_in_village, ph.photos, ph.worst
           FROM (SELECT DISTINCT place_id, group_id AS asset_id FROM grouped) p JOIN ga USING (asset_id) LEFT JOIN ph ON ph.asset_id = p.asset_id""",
       "grouped centres photo_rows")
def asset_detail(v):
    from ..operators import photos

    own = owned(v)
    rolled = photos.rollup(v.photo_rows.join(
        own.select(C("id").alias("report_id"), "asset_id").filter("asset_id is not null"), "report_id"), ["asset_id"])
    return views.asset_rank(own, given_assets(v)).join(rolled, "asset_id", "left").withColumn("worst", C("worst.damage_grade"))


@query("vw_11_own_reports", "VW-11", "id:i user_id:i status:s rank:i attachments_count:i",
       f"""SELECT s.id, s.user_id, s.status, s.rank, coalesce(p.n, 0) AS attachments_count FROM ({_STATUS}) s
           LEFT JOIN (SELECT report_id, count(*) AS n FROM photo_rows GROUP BY 1) p ON p.report_id = s.id WHERE s.user_id IS NOT NULL""",
       "located grouped clusters photo_rows")
def own_reports(v):
    return views.own_reports(with_cluster(v), views.ranked(v.clusters), v.photo_rows)


_PF = S.hav("p.lat", "p.lon", "f.p_lat", "f.p_lon")


@query("vw_12_candidate_facilities", "VW-12", "place_id:i facility_id:i distance_m:i",
       f"""SELECT p.id AS place_id, f.id AS facility_id, floor({_PF} * 1000 + 0.5e0) AS distance_m FROM places p JOIN facilities f
           ON (f.category = 'health' AND {_PF} <= 8) OR (f.category = 'education' AND ({_PF} * 1000 <= 2000 OR lower(trim(f.village)) = lower(trim(p.name))))""",
       "places facilities")
def candidate_facilities(v):
    return views.candidate_facilities(v.places, v.facilities)


@query("vw_12_village_picker", "VW-12", "id:i name:s",
       "SELECT id, name FROM places WHERE contains(lower(name), 'gaon') ORDER BY name, id LIMIT 50", "places")
def village_picker(v):
    return views.village_picker(v.places, "GAON", 50)


@query("vw_13_photo_checks", "VW-13", "attachment_id:i report_id:i verdict:s hidden:b",
       "SELECT attachment_id, report_id, verdict, TRUE AS hidden FROM photo_rows", "photo_rows")
def photo_checks(v):
    out = views.photo_public(v.photo_rows)
    return out.withColumn("hidden", F.lit(not {"ph", "dh", "capture_lat", "exif_lat"} & set(out.columns)))


@query("vw_14_scoped_ranking", "VW-14", "cluster_id:i priority_score:d",
       "SELECT cluster_id, priority_score FROM clusters WHERE issue_category = 'water' AND lower(district) = 'nation_1'", "clusters")
def scoped(v):
    return views.scoped_ranking(v.clusters, "water", "NATION_1")


@query("vw_14_villages_with_road", "VW-14", "place_id:i road:i",
       "SELECT place_id, count(*) AS road FROM located WHERE issue_category = 'road' GROUP BY place_id", "located")
def villages_with_road(v):
    t = given_villages(v).withColumn("road", F.try_element_at("counts_by_category", F.lit("road")))
    return t.filter("road > 0")
