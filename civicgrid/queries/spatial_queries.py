"""Joins by distance, time, key and name."""

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.geo import polyline_distance_m
from ..functions.rounding import portable_round
from ..operators import catchment, hazards, lookup, spatial
from ..operators.state import checkpoint
from . import sqltext as S
from .registry import query
from .views import AS_OF, AS_OF_SQL

C = F.col

_CV = S.hav("c.lat", "c.lon", "v.p_lat", "v.p_lon")
CATCH = f"""catch AS (
  SELECT c.group_id, c.category, c.lat, c.lon, v.*, {_CV} AS km FROM centres c JOIN village_records v ON {_CV} <=
     CASE c.category WHEN 'road' THEN 5 WHEN 'water' THEN 3 WHEN 'health' THEN 8 WHEN 'education' THEN 4 ELSE 4 END)"""


@query("jon_01_radius_join", "JON-01", "group_id:i place_id:i km:d",
       f"WITH {CATCH} SELECT group_id, place_id, km FROM catch", "centres village_records")
def radius(v):
    return catchment.villages_near(v.centres, v.village_records)


@query("jon_02_catchment_population", "JON-02", "group_id:i category:s people:i villages:i",
       f"""WITH {CATCH} SELECT c.group_id, c.category, coalesce(sum(k.population), 0) AS people,
           count(k.place_id) AS villages FROM centres c LEFT JOIN catch k USING (group_id)
           GROUP BY c.group_id, c.category""", "centres village_records")
def population(v):
    return catchment.catchment_population(v.centres, v.village_records)


HQ_KM = S.hav("c.lat", "c.lon", "p.lat", "p.lon")


@query("jon_03_nearest_headquarters", "JON-03", "group_id:i hq_km:d hq_id:i",
       f"""SELECT c.group_id, min({HQ_KM}) AS hq_km, arg_min(p.id, {HQ_KM}) AS hq_id
           FROM centres c JOIN places p ON p.admin_level = 'block' GROUP BY c.group_id""", "centres places")
def nearest_hq(v):
    out = catchment.headquarters_distance(v.centres, v.places)
    return out.select("group_id", "hq_km", "hq_id")


_ST = S.hav("c.lat", "c.lon", "s.p_lat", "s.p_lon")


@query("jon_04_nearest_within_cap", "JON-04", "place_id:i node_id:i node_km:d",
       f"""SELECT place_id, station_id AS node_id, km AS node_km FROM (
             SELECT c.id AS place_id, s.station_id, {_ST} AS km, row_number() OVER (PARTITION BY c.id ORDER BY {_ST}, s.station_id) AS rn
             FROM places c JOIN stations s ON {_ST} <= 15) x WHERE rn = 1""", "places stations")
def nearest_node(v):
    out = spatial.nearest_within(
        v.places, v.stations.select("station_id", "p_lat", "p_lon"), DEFAULTS.fibre_km, "id", ["station_id"])
    return out.select(C("id").alias("place_id"), C("station_id").alias("node_id"), C("km").alias("node_km"))


@query("jon_04_groundwater_station", "JON-04", "group_id:i station_id:i station_km:d level_m:d trend:s groundwater_text:s",
       f"""SELECT group_id, station_id, {S.rnd('km', 1)} AS station_km, level_m, coalesce(trend, 'stable') AS trend,
             'groundwater level in this area: ' || printf('%.1f', abs(level_m)) || 'm bgl, trend: ' || coalesce(trend, 'stable')
               AS groundwater_text FROM (
             SELECT c.group_id, s.*, {_ST} AS km, row_number() OVER (PARTITION BY c.group_id ORDER BY {_ST}, s.station_id) AS rn
             FROM centres c JOIN stations s ON {_ST} <= 25) x WHERE rn = 1 AND level_m IS NOT NULL""", "centres stations")
def groundwater(v):
    return hazards.groundwater(v.centres, v.stations)


_PP = S.hav("a.lat", "a.lon", "b.lat", "b.lon")


@query("jon_05_nearest_in_district", "JON-05", "place_id:i new_block:s hq_km:d",
       f"""SELECT place_id, new_block, km AS hq_km FROM (
             SELECT a.id AS place_id, b.name AS new_block, {_PP} AS km,
               row_number() OVER (PARTITION BY a.id ORDER BY {_PP}, b.id) AS rn
             FROM places a JOIN places b ON a.district = b.district AND b.admin_level = 'block') x WHERE rn = 1""",
       "places")
def block_by_hq(v):
    from ..plans.repair import assign_blocks

    out = assign_blocks(v.places, v.places.filter("admin_level = 'block'"))
    return out.filter("hq_km is not null").select(C("id").alias("place_id"), C("block").alias("new_block"), "hq_km")


def _piece(i: int, j: int) -> str:
    east = "(111139e0 * greatest(0.1e0, cos(radians(p.lat))))"
    x1, y1 = f"((lon{i} - p.lon) * {east})", f"((lat{i} - p.lat) * 111139e0)"
    dx, dy = f"((lon{j} - lon{i}) * {east})", f"((lat{j} - lat{i}) * 111139e0)"
    t = f"greatest(0e0, least(1e0, -({x1} * {dx} + {y1} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0)))"
    return f"sqrt(pow({x1} + {t} * {dx}, 2) + pow({y1} + {t} * {dy}, 2))"


LINE_M = f"least({_piece(0, 1)}, {_piece(1, 2)})"


def segment_table(v):
    point = [F.struct(C(f"lat{i}").alias("lat"), C(f"lon{i}").alias("lon")) for i in range(3)]
    return v.segments.select(
        "segment_id", "segment_code", "road_code", "road_name", F.array(*point).alias("points"),
        F.least("lat0", "lat1", "lat2").alias("min_lat"), F.greatest("lat0", "lat1", "lat2").alias("max_lat"),
        F.least("lon0", "lon1", "lon2").alias("min_lon"), F.greatest("lon0", "lon1", "lon2").alias("max_lon"))


@query("geo_03_polyline_distance", "GEO-03", "id:i metres:d",
       f"""SELECT p.id, {LINE_M} AS metres FROM located p JOIN segments s ON s.segment_id = p.facility_id""",
       "located segments")
def line_distance(v):
    s = segment_table(v).select(C("segment_id").alias("facility_id"), "points")
    return v.located.join(s, "facility_id").select(
        "id", polyline_distance_m(C("lat"), C("lon"), C("points")).alias("metres"))


@query("jon_06_nearest_segment", "JON-06", "id:i segment_id:i metres:d",
       f"""SELECT id, segment_id, metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, segment_id) AS rn
           FROM (SELECT p.id, s.segment_id, {LINE_M} AS metres FROM located p JOIN segments s
                 ON s.lat0 BETWEEN p.lat - 0.02e0 AND p.lat + 0.02e0 AND s.lon0 BETWEEN p.lon - 0.03e0 AND p.lon + 0.03e0
                 WHERE p.issue_category = 'road') x WHERE metres <= 500) y WHERE rn = 1""", "located segments")
def nearest_segment(v):
    # Reports share points: the distance runs once per distinct point.
    roads = v.located.filter("issue_category = 'road'")
    spot = F.xxhash64("lat", "lon").alias("spot")
    points = roads.select(spot, "lat", "lon").distinct()
    best = spatial.segments_near(points, segment_table(v), DEFAULTS.road_snap_m, "spot")
    return roads.select("id", spot).join(best, "spot").select("id", "segment_id", "metres")


_BOX = S.hav("c.lat", "c.lon", "least(greatest(c.lat, f.ymin), f.ymax)", "least(greatest(c.lon, f.xmin), f.xmax)")


@query("jon_07_flood_boxes", "JON-07", "group_id:i flood_events:i flood_years:s flood_km:d",
       f"""SELECT c.group_id, count(*) AS flood_events, string_agg(DISTINCT f.flood_year, ', ' ORDER BY f.flood_year) AS flood_years,
           {S.rnd(f'min({_BOX})', 2)} AS flood_km FROM centres c JOIN floods f ON {_BOX} <= 5 GROUP BY c.group_id""",
       "centres floods")
def floods(v):
    return hazards.flood_exposure(v.centres, v.floods)


_RF = S.hav("r.lat", "r.lon", "f.p_lat", "f.p_lon")


@query("jon_08_snap_to_facility", "JON-08", "id:i facility:i metres:d",
       f"""SELECT id, facility, metres FROM (SELECT r.id, f.id AS facility, {_RF} * 1000 AS metres,
             row_number() OVER (PARTITION BY r.id ORDER BY {_RF}, f.id) AS rn
             FROM located r JOIN facilities f ON f.category = r.issue_category AND {_RF} * 1000 <= 300
             WHERE r.precise_lat IS NOT NULL AND r.precise_lon IS NOT NULL) x WHERE rn = 1""", "located facilities")
def snap(v):
    from ..plans.assets import snap_to_facility

    out = snap_to_facility(v.located, v.facilities)
    return out.select("id", C("snap_id").alias("facility"), (C("snap_km") * 1000).alias("metres"))


@query("jon_09_nearest_health", "JON-09", "id:i facility:i km:d",
       f"""SELECT id, facility, km FROM (SELECT r.id, f.id AS facility, {_RF} AS km,
             row_number() OVER (PARTITION BY r.id ORDER BY {_RF}, f.id) AS rn
             FROM located r JOIN facilities f ON f.category = 'health' AND r.issue_category = 'health' AND {_RF} <= 8) x
           WHERE rn = 1""", "located facilities")
def nearest_health(v):
    from ..plans.assets import nearest_health_facility

    out = nearest_health_facility(v.located, v.facilities)
    return out.select("id", C("health_id").alias("facility"), C("health_km").alias("km"))


_VF = S.hav("p.lat", "p.lon", "f.p_lat", "f.p_lon")


@query("jon_10_school_shortlist", "JON-10", "place_id:i schools:s",
       f"""SELECT place_id, string_agg(cast(fid AS VARCHAR) || ':' || cast(cast(floor(km * 1000 + 0.5e0) AS BIGINT) AS VARCHAR), ','
             ORDER BY km, fid) AS schools FROM (SELECT p.id AS place_id, f.id AS fid, {_VF} AS km,
             row_number() OVER (PARTITION BY p.id ORDER BY {_VF}, f.id) AS rn FROM places p
             JOIN facilities f ON f.category = 'education' AND {_VF} <= 2) x WHERE rn <= 6 GROUP BY place_id""",
       "places facilities")
def shortlist(v):
    from ..plans.assets import school_shortlist

    out = school_shortlist(v.places.select(C("id").alias("place_id"), "lat", "lon"), v.facilities, "place_id")
    text = F.transform("candidates", lambda c: F.concat(
        c["facility_id"].cast("string"), F.lit(":"), c["distance_m"].cast("string")))
    return out.select("place_id", F.array_join(text, ",").alias("schools"))


_LG = S.hav("l.lat", "l.lon", "g.lat", "g.lon")
_SOME = "l.id % 3 <> 0"


@query("jon_11_attach_stragglers", "JON-11", "id:i group_id:i",
       f"""WITH g AS (SELECT group_id, issue_category AS category, avg(lat) AS lat, avg(lon) AS lon FROM grouped
                      WHERE id % 3 = 0 GROUP BY group_id, issue_category)
           SELECT id, group_id FROM (SELECT l.id, g.group_id, row_number() OVER (PARTITION BY l.id ORDER BY {_LG}, g.group_id) AS rn
           FROM grouped l JOIN g ON g.category = l.issue_category AND {_LG} <= 8 WHERE {_SOME}) x WHERE rn = 1""", "grouped")
def stragglers(v):
    from ..operators.cluster import attach_stragglers

    clustered = v.grouped.filter("id % 3 = 0").select("id", "issue_category", "group_id", "lat", "lon")
    return attach_stragglers(v.grouped.drop("group_id"), clustered)


_RV = S.hav("c.lat", "c.lon", "r.p_lat", "r.p_lon")


@query("jon_12_recent_readings_near", "JON-12", "group_id:i river_warnings:i nearest:s",
       f"""SELECT group_id, count(*) AS river_warnings, arg_min(gauge || ' ' || cast(reading AS VARCHAR),
             struct_pack(km, a := p_lat, b := p_lon, t := -epoch_us(observed_at), i := -reading_id)) AS nearest
           FROM (SELECT c.group_id, r.*, {_RV} AS km FROM centres c JOIN readings r ON {_RV} <= 25
                 WHERE r.observed_at >= {AS_OF_SQL} - INTERVAL '72' HOUR) x GROUP BY group_id""", "centres readings")
def rivers(v):
    out = hazards.river_warnings(v.centres, v.readings, AS_OF)
    near = F.concat(C("nearest_reading.gauge"), F.lit(" "), C("nearest_reading.reading").cast("string"))
    return out.select("group_id", "river_warnings", near.alias("nearest"))


ACTIVE = f"""(SELECT box_name, count(*) AS alerts, coalesce(string_agg(DISTINCT event, ', ' ORDER BY event), '') AS alert_events
  FROM alerts JOIN (SELECT 'Kolhapur' AS box_name UNION ALL SELECT 'Nashik') b ON districts LIKE '%' || box_name || '%'
  WHERE effective <= {AS_OF_SQL} AND expires >= {AS_OF_SQL} GROUP BY box_name)"""
BOX_OF = """CASE WHEN c.lat BETWEEN 15.7 AND 17.1 AND c.lon BETWEEN 73.7 AND 74.7 THEN 'Kolhapur'
  WHEN c.lat BETWEEN 19.6 AND 20.9 AND c.lon BETWEEN 73.3 AND 75.0 THEN 'Nashik' END"""


@query("jon_13_active_alerts", "JON-13", "group_id:i alerts:i alert_events:s",
       f"SELECT c.group_id, a.alerts, a.alert_events FROM centres c JOIN {ACTIVE} a ON a.box_name = {BOX_OF}",
       "centres alerts")
def alert_join(v):
    return hazards.alert_warnings(v.centres, v.alerts, AS_OF)


_K = "lower(trim(coalesce({c}, '')))"


def _k(c: str) -> str:
    return _K.replace("{c}", c)


LOOKUP_SQL = f"""found AS (
  SELECT r.id AS rid, coalesce(a.pid, b.pid, c.pid) AS place_id FROM reports r
  LEFT JOIN (SELECT {_k('district')} AS d, {_k('block')} AS b, {_k('name')} AS v, max(id) AS pid FROM places GROUP BY 1, 2, 3) a
    ON a.d = {_k('r.district')} AND a.b = {_k('r.block')} AND a.v = {_k('r.village')} AND a.d <> '' AND a.b <> '' AND a.v <> ''
  LEFT JOIN (SELECT {_k('district')} AS d, {_k('name')} AS v, min(id) AS pid FROM places GROUP BY 1, 2) b
    ON b.d = {_k('r.district')} AND b.v = {_k('r.village')} AND b.d <> '' AND b.v <> ''
  LEFT JOIN (SELECT {_k('name')} AS v, min(id) AS pid FROM places GROUP BY 1) c ON c.v = {_k('r.village')} AND c.v <> '')"""

_MANGLED = """(SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE upper(district) END AS district,
  CASE WHEN id % 3 = 0 THEN 'elsewhere' ELSE ' ' || block END AS block, upper(village) || ' ' AS village FROM {reports})"""


@query("jon_14_place_lookup", "JON-14", "id:i place_id:i",
       "WITH " + LOOKUP_SQL.replace("FROM reports r", "FROM " + _MANGLED.format(reports="reports") + " r")
       + " SELECT rid AS id, place_id FROM found", "reports places")
def fallback(v):
    return lookup.place_lookup(v.sql("SELECT * FROM " + _MANGLED), v.places).select("id", "place_id")


@query("jon_15_village_records", "JON-15", "place_id:i has_real_data:b households:i tap:d",
       """SELECT p.id AS place_id, a.place_id IS NOT NULL AS has_real_data, a.households, a.jjm_tap_coverage_pct AS tap
          FROM places p LEFT JOIN amenities a ON a.place_id = p.id""", "places amenities")
def village_left(v):
    out = catchment.village_index(v.places, v.amenities)
    return out.select("place_id", "has_real_data", "households", C("jjm_tap_coverage_pct").alias("tap"))


@query("jon_16_undelivered_works", "JON-16", "group_id:i work_id:i status:s",
       f"""WITH {CATCH} SELECT k.group_id, w.work_id, w.status FROM works w JOIN catch k ON k.place_id = w.place_id
           WHERE w.status IN ('Not Started', 'In Progress', 'Agreement Cancelled')""", "centres village_records works")
def open_works(v):
    near = catchment.villages_near(v.centres, v.village_records.select("place_id", "p_lat", "p_lon"))
    return near.select("group_id", "place_id").join(
        v.works.filter(catchment.undelivered(C("status"))), "place_id").select("group_id", "work_id", "status")


@query("jon_17_works_by_village", "JON-17", "village:s works:i first_six:s",
       """SELECT village, count(*) AS works, string_agg(cast(work_id AS VARCHAR), ',' ORDER BY work_id) FILTER (rn <= 6) AS first_six
          FROM (SELECT p.name AS village, w.work_id, row_number() OVER (PARTITION BY p.name ORDER BY w.work_id) AS rn
                FROM works w JOIN places p ON p.id = w.place_id) x GROUP BY village""", "works places")
def works_named(v):
    from ..operators.cluster import works_by_village

    out = works_by_village(v.works, v.places)
    ids = F.transform("works", lambda w: w["external_id"].cast("string"))
    return out.select("village", C("n_works").alias("works"), F.array_join(ids, ",").alias("first_six"))


@query("jon_21_backfill_point", "JON-21", "id:i lat:d lon:d backfilled:b",
       f"""WITH holes AS (SELECT id, district, village, CASE WHEN id % 3 = 0 THEN NULL ELSE latitude END AS latitude,
             CASE WHEN id % 5 = 0 THEN NULL ELSE longitude END AS longitude FROM reports)
           SELECT h.id, CASE WHEN h.latitude IS NULL OR h.longitude IS NULL THEN coalesce(a.lat, b.lat) ELSE h.latitude END AS lat,
             CASE WHEN h.latitude IS NULL OR h.longitude IS NULL THEN coalesce(a.lon, b.lon) ELSE h.longitude END AS lon,
             (h.latitude IS NULL OR h.longitude IS NULL) AND coalesce(a.lat, b.lat) IS NOT NULL AS backfilled
           FROM holes h
           LEFT JOIN (SELECT {_k('district')} AS d, {_k('name')} AS v, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon
                      FROM places GROUP BY 1, 2) a ON a.d = {_k('h.district')} AND a.v = {_k('h.village')}
           LEFT JOIN (SELECT {_k('name')} AS v, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM places GROUP BY 1) b
             ON b.v = {_k('h.village')}""", "reports places")
def backfill(v):
    holes = v.reports.select(
        "id", "district", "village", F.when(C("id") % 3 != 0, C("latitude")).alias("latitude"),
        F.when(C("id") % 5 != 0, C("longitude")).alias("longitude"))
    out = lookup.backfill_point(holes, v.places)
    return out.select("id", C("latitude").alias("lat"), C("longitude").alias("lon"), "backfilled")


_RS = S.hav("f.p_lat", "f.p_lon", "r.lat", "r.lon")


@query("jon_22_school_reports", "JON-22", "facility_id:i nearby_reports:i",
       f"""SELECT f.id AS facility_id, count(r.id) AS nearby_reports FROM facilities f JOIN located r
           ON r.issue_category = 'education' AND (r.facility_id = f.id OR {_RS} <= 5)
           WHERE f.category = 'education' GROUP BY f.id""", "facilities located")
def school_reports(v):
    from ..plans.invest import reports_per_school

    return reports_per_school(v.located, v.facilities.filter("category = 'education'"))


@query("jon_23_latest_score", "JON-23", "cluster_id:i score:d score_id:i",
       """SELECT c.group_id AS cluster_id, s.score, s.score_id FROM centres c LEFT JOIN (
            SELECT group_id, arg_max(confidence, id) AS score, max(id) AS score_id FROM grouped
            WHERE confidence IS NOT NULL GROUP BY group_id) s USING (group_id)""", "centres grouped")
def latest_score(v):
    from ..plans.views import latest_scores

    scores = v.grouped.filter("confidence is not null").select(
        C("group_id").alias("cluster_id"), C("confidence").alias("score"), C("id").alias("score_id"))
    last = latest_scores(scores)
    return v.centres.select(C("group_id").alias("cluster_id")).join(last, "cluster_id", "left").select(
        "cluster_id", "score", "score_id")


SITES_SQL = """sites AS (SELECT issue_category AS category, lat, lon, vec, min(id) AS id, count(*) AS w FROM (
  SELECT l.*, e.embedding AS vec FROM located l JOIN embeddings e ON e.vec_id = l.id % (SELECT count(*) FROM embeddings))
  WHERE issue_category IS NOT NULL GROUP BY ALL)"""
_AB = S.hav("a.lat", "a.lon", "b.lat", "b.lon")
GAP = f"({_AB} + 3 * (1 - list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[])))"


@query("jon_24_gated_pairs", "JON-24", "a:i neighbours:i nearest:d",
       f"""WITH {SITES_SQL} SELECT a.id AS a, count(*) AS neighbours, min({GAP}) AS nearest FROM sites a JOIN sites b
           ON a.category = b.category AND a.id <> b.id AND abs(a.lat - b.lat) < 0.06e0 AND {GAP} <= 6 GROUP BY a.id""",
       "located")
def gated_pairs(v):
    from ..operators.meetings import neighbour_counts

    sites = report_vectors(v).groupBy("category", "lat", "lon", "vec").agg(F.min("id").alias("id"))
    return neighbour_counts(checkpoint(sites), ["category"], DEFAULTS.eps_km, DEFAULTS.semantic_km).withColumnRenamed("id", "a")


def report_vectors(v):
    """Reports with category, point and a stored vector (event id modulo the number of vectors)."""
    n = v.embeddings.count()
    vectors = v.embeddings.select(C("vec_id").alias("vid"), C("embedding").cast("array<double>").alias("vec"))
    return v.located.filter("issue_category is not null").withColumn("vid", C("id") % n).join(vectors, "vid").select(
        "id", C("issue_category").alias("category"), "lat", "lon", "vec")


@query("jon_25_assignment_back", "JON-25", "id:i cluster_id:i",
       """SELECT l.id, g.group_id AS cluster_id FROM located l LEFT JOIN grouped g ON g.id = l.id AND g.id % 7 <> 0""",
       "located grouped")
def write_back(v):
    from ..operators.cluster import assign

    return assign(v.located, v.grouped.filter("id % 7 <> 0").select("id", C("group_id").alias("cluster_id"))).select(
        "id", "cluster_id")
