"""Scores, assets, villages and money end to end."""

from pyspark.sql import functions as F

from ..functions.nested import map_text
from ..functions.numeric import TERMS
from ..plans import assets, recompute, score, villages
from . import sqltext as S
from .aggregate_queries import BASE, BURST, ELIGIBLE, FACTS, FIBRE, INFRA, ROADSHARE, VULN, WHO, emergency_ctes
from .cluster_queries import CLUSTERS
from .registry import query, register
from .spatial_queries import HQ_KM, LOOKUP_SQL, segment_table
from .views import AS_OF, THIS_YEAR

C = F.col
NINE = " ".join(f"{t}:d" for t in TERMS)


def registers(v) -> score.Registers:
    return score.Registers(
        places=v.places, villages=v.village_records, works=v.works, schemes=v.schemes, water_tests=v.water_tests,
        employment=v.employment, stations=v.stations, readings=v.readings, alerts=v.alerts, floods=v.floods,
        photos=v.photo_rows, school_rows=v.school_rows, facilities=v.facilities, segments=segment_table(v))


SCORE_VIEWS = BASE + " grouped stations readings alerts photo_rows places"
INPUTS = f"""{FACTS}, {BURST}, {emergency_ctes()},
who AS (SELECT group_id, count(DISTINCT {WHO}) AS reporters, count(DISTINCT village) AS settlements, avg({S.SEVERITY}) AS severity_mean,
        coalesce(avg(confidence), 0) AS confidence, avg(CASE WHEN lower(coalesce(severity, '')) = 'high' THEN 1e0 ELSE 0e0 END) AS high_share
        FROM grouped GROUP BY group_id),
blk AS (SELECT group_id, block FROM (SELECT group_id, block, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(id)) AS rn
        FROM grouped WHERE block <> '' GROUP BY 1, 2) WHERE rn = 1),
hq AS (SELECT c.group_id, min({HQ_KM}) AS hq_km FROM centres c JOIN places p ON p.admin_level = 'block' GROUP BY 1),
ready AS (SELECT f.*, w.reporters, w.settlements, w.severity_mean, w.confidence, w.high_share, blk.block, hq.hq_km,
  {S.VELOCITY.replace('{r}', 'coalesce(b.burst, 0)')} AS velocity, {INFRA} AS real_infra, {VULN} AS real_vulnerability,
  {FIBRE} AS reporting_deficit, {ELIGIBLE} AS eligible, {ROADSHARE} AS road_share, e.grade, e.grade_label, e.grade_confidence,
  greatest(0, {THIS_YEAR} - CASE WHEN f.category = 'water' AND records > 0 AND tap_villages > 0 THEN 2024
    WHEN f.category = 'road' AND oldest_undelivered_year IS NOT NULL THEN oldest_undelivered_year ELSE 2011 END) * 1e0 AS infra_age,
  greatest(0, {THIS_YEAR} - 2011) * 1e0 AS vuln_age
  FROM facts f JOIN who w USING (group_id) LEFT JOIN blk USING (group_id) LEFT JOIN hq USING (group_id) LEFT JOIN burst b USING (group_id)
  LEFT JOIN em e USING (group_id))"""


@query("pip_04_score_groups", "PIP-04", f"group_id:i category:s {NINE} gap_score:d confidence_gate:d priority_score:d",
       f"WITH {INPUTS} " + S.score_sql("ready", "group_id, category", "severity_mean"), SCORE_VIEWS)
def score_all(v):
    return score.score_groups(v.grouped, v.centres, registers(v), AS_OF)


def vectors(v):
    n = v.embeddings.count()
    e = v.embeddings.select(C("vec_id").alias("vid"), C("embedding").alias("vec"))
    return v.located.select("id", (C("id") % n).alias("vid")).join(e, "vid").select("id", "vec")


def full(v) -> recompute.Outputs:
    return recompute.recompute(v.located, vectors(v), registers(v), AS_OF)


_LG = S.hav("l.lat", "l.lon", "g.lat", "g.lon")
# Clusters found by the density rule, under the names the score reads.
FOUND = f"""{CLUSTERS}, first_pass AS (SELECT l.*, c.cluster_id AS group_id FROM located l JOIN clustered c ON c.id = l.id),
gc AS (SELECT group_id, issue_category AS category, avg(lat) AS lat, avg(lon) AS lon FROM first_pass GROUP BY 1, 2),
late AS (SELECT id, group_id FROM (SELECT l.id, g.group_id, row_number() OVER (PARTITION BY l.id ORDER BY {_LG}, g.group_id) AS rn
  FROM located l JOIN gc g ON g.category = l.issue_category AND {_LG} <= 8 WHERE l.id NOT IN (SELECT id FROM first_pass)) x WHERE rn = 1),
grouped AS (SELECT * FROM first_pass UNION ALL SELECT l.*, t.group_id FROM located l JOIN late t ON t.id = l.id),
centres AS (SELECT group_id, min(issue_category) AS category, avg(lat) AS lat, avg(lon) AS lon, count(*) AS report_count FROM grouped GROUP BY group_id)"""

register("pip_03_demand_clusters", "PIP-03", "id:i group_id:i",
         lambda v: recompute.demand_clusters(v.located, vectors(v)), f"WITH {FOUND} SELECT id, group_id FROM grouped", "located")

RANKED_VIEWS = "located village_records works schemes water_tests employment stations readings alerts photo_rows places"
RANKED = f"""WITH {FOUND}, {INPUTS}, nine AS ({S.score_sql('ready', 'group_id, category, reporters, people', 'severity_mean')}),
dst AS (SELECT group_id, district FROM (SELECT group_id, district, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(id)) AS rn
  FROM grouped WHERE district <> '' GROUP BY 1, 2) WHERE rn = 1)
SELECT row_number() OVER (ORDER BY priority_score DESC, nine.group_id) AS rank, lead(nine.group_id) OVER (ORDER BY priority_score DESC, nine.group_id) AS runner_up_cluster_id,
  nine.group_id AS cluster_id, nine.* EXCLUDE (group_id), dst.district FROM nine LEFT JOIN dst ON dst.group_id = nine.group_id"""


@query("ranked_clusters", "PIP-17", f"rank:i cluster_id:i category:s district:s reporters:i people:i {NINE} priority_score:d runner_up_cluster_id:i",
       RANKED, RANKED_VIEWS)
def ranked(v):
    _, clusters = recompute.scored_clusters(v.located, vectors(v), registers(v), AS_OF)
    return clusters.withColumnRenamed("group_id", "cluster_id")


@query("pip_17_full_recompute", "PIP-17", "table_name:s rows:i top_score:d")
def full_recompute(v):
    out = full(v)
    parts = [
        t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"),
              (F.max("priority_score") if "priority_score" in t.columns else F.lit(None).cast("double")).alias("top_score"))
        for n, t in (("members", out.members), ("clusters", out.clusters), ("work_groups", out.work_groups),
                     ("assets", out.assets), ("villages", out.villages))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


_RF = S.hav("r.lat", "r.lon", "f.p_lat", "f.p_lon")
CASCADE = f"""{LOOKUP_SQL},
near_f AS (SELECT r.id, f.id AS fid, {_RF} AS km, f.category FROM located r JOIN facilities f ON f.category = r.issue_category AND {_RF} <= 8),
snap AS (SELECT id, arg_min(fid, struct_pack(km, fid)) AS fid FROM (SELECT n.* FROM near_f n JOIN located r ON r.id = n.id
         WHERE r.precise_lat IS NOT NULL AND r.precise_lon IS NOT NULL AND km * 1000 <= 300) GROUP BY id),
hlth AS (SELECT id, arg_min(fid, struct_pack(km, fid)) AS fid FROM near_f WHERE category = 'health' GROUP BY id),
casc AS (SELECT r.id, r.issue_category, k.place_id, r.pin_source, pf.id AS pick, s.fid AS snapped, CASE WHEN r.issue_category = 'health' THEN h.fid END AS hfid
  FROM located r JOIN found k ON k.rid = r.id LEFT JOIN facilities pf ON pf.id = r.facility_id AND pf.category = r.issue_category
  LEFT JOIN snap s ON s.id = r.id LEFT JOIN hlth h ON h.id = r.id)"""


@query("pip_05_asset_cascade", "PIP-05", "id:i place_id:i kind:s basis:s facility:i",
       f"""WITH {CASCADE} SELECT id, place_id, coalesce(pick, snapped, hfid) AS facility,
           CASE WHEN coalesce(pick, snapped, hfid) IS NOT NULL THEN 'facility' WHEN issue_category IN ('education', 'health') THEN 'unresolved' ELSE 'group' END AS kind,
           CASE WHEN pick IS NOT NULL THEN CASE WHEN pin_source = 'synthetic_seed' THEN 'demo_assigned' ELSE 'citizen_selected' END
             WHEN coalesce(snapped, hfid) IS NOT NULL THEN 'nearest_register' WHEN issue_category IN ('education', 'health') THEN 'unresolved_village'
             ELSE 'unnamed_pin' END AS basis FROM casc""", "located reports places facilities")
def cascade(v):
    return assets.resolve_assets(v.located, v.facilities, v.places)


@query("pip_05_named_assets", "PIP-05",
       "asset_id:i asset_type:s name:s name_basis:s external_id:s location_basis:s village:s report_count:i lat:d lon:d")
def named(v):
    resolved = assets.resolve_assets(v.located, v.facilities, v.places)
    return assets.name_assets(resolved, v.facilities, v.places, v.works, segment_table(v))


# Assets given by the grid groups, with a score by arithmetic.
GIVEN = """SELECT group_id AS asset_id, (group_id * 7) % 1000 / 10e0 AS priority_score,
  CASE group_id % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'partial' WHEN 2 THEN 'collapse' ELSE NULL END AS grade_label,
  (group_id % 10) / 10e0 AS grade_confidence FROM {centres}"""
GIVEN_SQL = GIVEN.format(centres="centres")
_G3 = "CASE grade_label WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 WHEN 'collapse' THEN 3 ELSE 0 END"
VILLAGES = f"""ga AS ({GIVEN_SQL}), rr AS (SELECT l.*, g.group_id AS asset_id FROM located l LEFT JOIN grouped g ON g.id = l.id),
vc AS (SELECT place_id, sum(n) AS report_count, bool_and(demo) AS is_demo,
       coalesce(string_agg(issue_category || '=' || cast(n AS VARCHAR), ',' ORDER BY issue_category), '') AS counts
       FROM (SELECT place_id, issue_category, count(*) AS n, bool_and(is_synthetic) AS demo FROM rr GROUP BY 1, 2) x GROUP BY 1),
vp AS (SELECT DISTINCT place_id, asset_id FROM rr WHERE asset_id IS NOT NULL),
vt AS (SELECT place_id, count(*) AS asset_count, max(priority_score) AS priority_score, arg_max(asset_id, struct_pack(s := priority_score, a := asset_id)) AS top_asset_id,
       arg_max(asset_id, struct_pack(g := {_G3}, c := grade_confidence, a := -asset_id)) FILTER (grade_label IS NOT NULL) AS urgent_asset_id,
       arg_max(grade_label, struct_pack(g := {_G3}, c := grade_confidence, a := -asset_id)) FILTER (grade_label IS NOT NULL) AS urgent_grade_label
       FROM vp JOIN ga USING (asset_id) GROUP BY 1),
vill AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY priority_score DESC, report_count DESC, village, place_id) AS rank_in_district FROM (
  SELECT p.id AS place_id, p.name AS village, p.block, p.district, p.lat, p.lon, vc.report_count, vc.counts, vc.is_demo, coalesce(vt.asset_count, 0) AS asset_count,
  coalesce(vt.priority_score, 0) AS priority_score, top_asset_id, urgent_asset_id, urgent_grade_label
  FROM places p JOIN vc ON vc.place_id = p.id LEFT JOIN vt ON vt.place_id = p.id) y)"""
VILLAGE_VIEWS = "places located grouped centres"


def given_assets(v):
    return v.sql(GIVEN)


def given_villages(v):
    own = v.located.join(v.grouped.select("id", C("group_id").alias("asset_id")), "id", "left")
    return villages.village_priorities(own, given_assets(v), v.places)


@query("pip_06_village_priorities", "PIP-06",
       "place_id:i village:s district:s report_count:i counts:s asset_count:i priority_score:d top_asset_id:i urgent_asset_id:i urgent_grade_label:s is_demo:b rank_in_district:i",
       f"WITH {VILLAGES} SELECT * FROM vill", VILLAGE_VIEWS)
def village_table(v):
    return given_villages(v).withColumn("counts", map_text(C("counts_by_category")))
