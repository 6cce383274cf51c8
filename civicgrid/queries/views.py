"""Civic tables derived from the driver's test tables, as SQL that Spark and DuckDB read alike.

Real deployments read ``sources``; these views only give the queries registered for checking something to run on.
``{name}`` is a test table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
THIS_YEAR = 2024

LAT = "(15.7e0 + ({k} * 397) % 1400 / 1000.3e0)"
LON = "(73.7e0 + ({k} * 611) % 1000 / 1000.3e0)"


def lat(k: str) -> str:
    return LAT.replace("{k}", k)


def lon(k: str) -> str:
    return LON.replace("{k}", k)


def place_name(k: str) -> str:
    head = f"substr('KarMalPatRajSonTalVadNerBelDeoGhoHatJaiLonMunOtuPimRohShiUmb', cast(1 + 3 * ({k} % 20) AS INT), 3)"
    mid = (
        "substr('agaradeviguhekilomanenipopurisatuvayozaba',"
        f" cast(1 + 2 * (cast(floor({k} / 20e0) AS BIGINT) % 20) AS INT), 2)"
    )
    tail = (
        "substr('gaon wadi pur  hallinagar',"
        f" cast(1 + 5 * (cast(floor({k} / 400e0) AS BIGINT) % 5) AS INT), 5)"
    )
    return f"({head} || {mid} || trim({tail}))"


VIEWS: dict[str, str] = {}

VIEWS["places"] = f"""
SELECT c_custkey AS id, {place_name('c_custkey')} AS name, CASE WHEN c_custkey % 50 = 3 THEN 'block' ELSE 'village' END AS admin_level, n_name AS district,
       CASE c_custkey % 11 WHEN 0 THEN 'Chandgad' WHEN 1 THEN 'Peth' ELSE c_mktsegment END AS block,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS population,
       {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
"""

# Every seventh record carries a key that no place has, so that some places are without records.
VIEWS["amenities"] = """
SELECT CASE WHEN c_custkey % 7 = 6 THEN -c_custkey ELSE c_custkey END AS place_id,
       CAST(20 + (c_custkey * 7) % 400 AS BIGINT) AS households,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS road_black_topped,
       CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN 0 ELSE 1 END AS road_all_weather,
       CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS water_tap_treated,
       CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 0 ELSE 1 END AS water_tap_treated_summer,
       CASE WHEN c_custkey % 3 = 1 THEN (c_custkey * 13) % 101 * 1e0 ELSE NULL END AS jjm_tap_coverage_pct,
       CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE CAST((c_custkey * 11) % 300 AS BIGINT) END AS jjm_households,
       CAST(c_custkey % 9 AS BIGINT) AS n9,
       CASE WHEN c_custkey % 25 = 2 THEN 1 ELSE 0 END AS health_phc_count,
       CASE WHEN c_custkey % 60 = 3 THEN 1 ELSE 0 END AS health_chc_count,
       CASE WHEN c_custkey % 10 = 4 THEN NULL WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS health_subcentre_count,
       CASE WHEN c_custkey % 25 = 2 THEN 3 ELSE NULL END AS health_doctors_sanctioned,
       CASE WHEN c_custkey % 25 = 2 THEN CAST(c_custkey % 4 AS INT) ELSE NULL END AS health_doctors_in_position,
       CASE c_custkey % 7 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN NULL ELSE 'a' END AS health_nearest_band,
       CASE WHEN c_custkey % 5 = 2 THEN 0 ELSE 1 END AS school_middle,
       CASE WHEN c_custkey % 3 = 2 THEN 0 WHEN c_custkey % 10 = 9 THEN NULL ELSE 1 END AS school_secondary,
       CASE c_custkey % 9 WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE 'a' END AS school_primary_nearest_band,
       CASE WHEN c_custkey % 8 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS conn_internet_csc,
       CASE c_custkey % 6 WHEN 0 THEN 'Down' WHEN 1 THEN 'UP' WHEN 2 THEN 'unknown prev down' WHEN 3 THEN ''
            WHEN 4 THEN NULL ELSE '#N/A' END AS conn_bharatnet_status,
       CASE WHEN c_custkey % 9 = 3 THEN NULL ELSE (c_custkey * 17) % 60 * 1e0 END AS dist_nearest_town_km,
       CASE WHEN c_custkey % 12 = 5 THEN NULL ELSE (c_custkey * 19) % 25 * 1e0 END AS power_domestic_summer_hrs,
       CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS drainage_none
FROM {customer}
"""

VIEWS["village_records"] = """
SELECT p.id AS place_id, p.name AS place_name, p.district, p.block, p.population, p.lat AS p_lat, p.lon AS p_lon,
       a.place_id IS NOT NULL AS has_real_data, a.households, a.road_black_topped, a.road_all_weather,
       a.water_tap_treated, a.water_tap_treated_summer, a.jjm_tap_coverage_pct, a.jjm_households,
       a.health_phc_count, a.health_chc_count, a.health_subcentre_count, a.health_doctors_sanctioned,
       a.health_doctors_in_position, a.health_nearest_band, a.school_middle, a.school_secondary,
       a.school_primary_nearest_band, a.conn_internet_csc, a.conn_bharatnet_status, a.dist_nearest_town_km,
       a.power_domestic_summer_hrs, a.drainage_none
FROM {places} p LEFT JOIN {amenities} a ON p.id = a.place_id
"""

VIEWS["phrases"] = """
SELECT 0 AS k, 'The road has a pothole and is very bad, urgent repair please' AS phrase
UNION ALL SELECT 1, 'सड़क टूटी है, बहुत गड्ढे हैं'
UNION ALL SELECT 2, 'sadak bahut kharab hai, accident hota hai'
UNION ALL SELECT 3, 'the culvert has collapsed and was washed away'
UNION ALL SELECT 4, 'minor crack in the bridge, sometimes unsafe'
UNION ALL SELECT 5, 'no drinking water, the tap is dry and pipeline leakage'
UNION ALL SELECT 6, 'paani nahi aata, borewell band hai matlab supply shortage'
UNION ALL SELECT 7, 'आमच्या गावात पाणी नाही आणि नळ बंद आहे'
UNION ALL SELECT 8, 'umm the hospital has no doctor, you know medicine is not available'
UNION ALL SELECT 9, 'aspatal mein doctor nahi, call 9876543210'
UNION ALL SELECT 10, 'दवाखाना बंद आहे, भिंतीला तडा गेला आहे'
UNION ALL SELECT 11, 'school roof is damaged, classroom wall cracked, says Shri Kumar'
UNION ALL SELECT 12, 'mera naam Ravi Patil hai, shaala ki chhat gir gayi'
UNION ALL SELECT 13, 'teacher nahi hai, thoda problem kabhi kabhi'
UNION ALL SELECT 14, 'nothing in particular'
UNION ALL SELECT 15, 'सड़क road वर्ग mixed खराब है'
UNION ALL SELECT 16, 'நீர் இல்லை'
UNION ALL SELECT 17, ''
UNION ALL SELECT 18, 'my name is Asha Jadhav, water tank wall collapsed'
"""

VIEWS["reports"] = f"""
SELECT e.event_id AS id, CASE WHEN e.event_id % 4 = 3 THEN NULL ELSE e.user_id END AS user_id,
       CASE WHEN h.k = 17 THEN h.phrase
            WHEN e.event_id % 3 = 0 THEN 'Near ' || p.name || ' village ' || h.phrase
            WHEN e.event_id % 3 = 1 THEN h.phrase || ' ' || p.name || ' ke paas'
            ELSE h.phrase END AS raw_text,
       CASE e.event_type WHEN 'view' THEN 'road' WHEN 'click' THEN 'water' WHEN 'error' THEN 'health'
            WHEN 'signup' THEN 'education' ELSE NULL END AS issue_category,
       CASE WHEN e.event_id % 10 < 3 THEN 'high' WHEN e.event_id % 10 < 8 THEN 'medium'
            WHEN e.event_id % 10 = 8 THEN 'low' ELSE NULL END AS severity,
       p.district, p.block, CASE WHEN e.event_id % 29 = 5 THEN NULL ELSE p.name END AS village, p.id AS place_id,
       CASE WHEN e.event_id % 11 = 0 THEN 15.7e0 + (e.event_id * 37) % 1400 / 1000e0
            ELSE p.lat END AS latitude,
       CASE WHEN e.event_id % 11 = 0 THEN 73.7e0 + (e.event_id * 91) % 1000 / 1000e0
            ELSE p.lon END AS longitude,
       CASE WHEN e.event_id % 11 <> 0 AND e.event_id % 2 = 0 THEN p.lat + e.event_id % 5 * 0.004e0
            ELSE NULL END AS precise_lat,
       CASE WHEN e.event_id % 11 <> 0 AND e.event_id % 2 = 0 AND e.event_id % 14 <> 0
            THEN p.lon + e.event_id % 3 * 0.004e0 ELSE NULL END AS precise_lon,
       CASE WHEN e.event_id % 11 = 0 OR e.event_id % 2 = 1 THEN NULL WHEN e.event_id % 16 = 0 THEN 'synthetic_seed'
            ELSE 'citizen_gps' END AS pin_source,
       CASE WHEN e.event_id % 9 = 0 THEN e.user_id * 13 + e.event_id % 13 ELSE NULL END AS facility_id,
       CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE 0.3e0 + e.event_id % 70 / 101.7e0 END AS confidence,
       e.ts AS created_at, e.event_id % 5 = 0 AS is_synthetic
FROM {{events}} e JOIN {{places}} p ON p.id = e.user_id JOIN {{phrases}} h ON h.k = e.event_id % 19
"""

VIEWS["located"] = """
SELECT id, user_id, raw_text, issue_category, severity, district, block, village, place_id,
       CASE WHEN precise_lat IS NOT NULL AND precise_lon IS NOT NULL THEN precise_lat ELSE latitude END AS lat,
       CASE WHEN precise_lat IS NOT NULL AND precise_lon IS NOT NULL THEN precise_lon ELSE longitude END AS lon,
       precise_lat, precise_lon, pin_source, facility_id, confidence, created_at, is_synthetic
FROM {reports}
"""

# Groups given by a 0.1 degree grid, for every query that needs clusters without running the clustering.
VIEWS["grouped"] = """
SELECT *, CASE issue_category WHEN 'road' THEN 1 WHEN 'water' THEN 2 WHEN 'health' THEN 3 ELSE 4 END * 1000000
       + CAST(floor((lat - 15e0) / 0.1e0) AS BIGINT) * 1000 + CAST(floor((lon - 73e0) / 0.1e0) AS BIGINT) AS group_id
FROM {located} WHERE issue_category IS NOT NULL
"""

VIEWS["centres"] = """
SELECT group_id, min(issue_category) AS category, avg(lat) AS lat, avg(lon) AS lon, count(*) AS report_count
FROM {grouped} GROUP BY group_id
"""

# Scored clusters given by the grid, with terms by arithmetic.
VIEWS["clusters"] = """
SELECT t.*, demand + population + infra_deficit + vulnerability + equity + strategic + urgency + feasibility + cost_penalty AS priority_score
FROM (SELECT c.group_id AS cluster_id, c.category AS issue_category, c.lat AS centroid_lat, c.lon AS centroid_lon, c.report_count,
  g.district, g.block, g.people AS population_affected, (c.group_id * 3 % 70) / 4e0 AS demand, (c.group_id * 7 % 70) / 4e0 AS population,
  (c.group_id * 11 % 70) / 4e0 AS infra_deficit, (c.group_id * 13 % 70) / 4e0 AS vulnerability, (c.group_id % 11) * 1e0 AS equity,
  CASE WHEN c.group_id % 3 = 0 THEN 4e0 ELSE 0e0 END AS strategic, (c.group_id % 16) * 1e0 AS urgency, (c.group_id % 9) / 4e0 AS feasibility,
  -(c.group_id % 13) / 4e0 AS cost_penalty
  FROM {centres} c JOIN (SELECT group_id, min(district) AS district, min(block) AS block, sum(id) % 90000 AS people FROM {grouped} GROUP BY group_id) g
  ON g.group_id = c.group_id) t
"""

VIEWS["facilities"] = f"""
SELECT p_partkey AS id, p_name || ' ' || cast(p_partkey AS STRING) AS name, 'X' || cast(p_partkey AS STRING) AS external_id,
       CASE WHEN p_partkey % 4 = 0 THEN 'nic_healthgis' ELSE 'udise' END AS source,
       CASE WHEN p_partkey % 4 = 0 THEN 'health' ELSE 'education' END AS category, p_type AS sub_type,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS management, c.name AS village, c.district,
       {lat('p_partkey * 3')} + 0.001e0 AS p_lat, {lon('p_partkey * 3')} + 0.001e0 AS p_lon
FROM {{part}} JOIN {{places}} c ON c.id = CAST(floor(p_partkey * 0.75e0) AS BIGINT)
"""

VIEWS["school_rows"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS facility_id, '2023-24' AS year_desc,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END AS teachers_regular,
       CAST(l_orderkey % 3 AS INT) AS teachers_contract,
       CAST(l_quantity AS INT) % 9 AS classrooms_total, CAST(l_quantity AS INT) % 3 AS classrooms_major_repair,
       CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_orderkey % 5 <> 0 END AS electricity,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_orderkey % 11 <> 0 END AS drinking_water,
       CASE WHEN l_orderkey % 6 = 0 THEN 0 WHEN l_orderkey % 6 = 1 THEN NULL ELSE 2 END AS toilet_boys_functional,
       CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE 1 END AS toilet_girls_functional,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS total_grant,
       CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE floor(l_extendedprice * l_discount * 10) END AS total_expenditure,
       l_orderkey % 4 = 3 AS fetch_failed
FROM {lineitem}
"""

VIEWS["works"] = """
SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_custkey END AS place_id,
       'Road work ' || cast(o_orderkey AS STRING) AS work_name, o_orderkey AS external_id,
       CASE WHEN o_orderkey % 13 = 0 THEN 'Agreement Cancelled' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0
            THEN 'In Progress' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'Not Started'
            ELSE 'Completed' END AS status,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS BIGINT) END AS sanction_year,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE floor(o_totalprice) / 99731e0 END AS cost_lakh,
       1e0 + o_orderkey % 9 AS length_km
FROM {orders}
"""

VIEWS["schemes"] = """
SELECT l_orderkey * 10 + l_linenumber AS scheme_id, CAST(floor(l_orderkey / 10e0) AS BIGINT) AS place_id,
       'Scheme ' || cast(l_orderkey AS STRING) AS scheme_name,
       CASE WHEN l_linestatus = 'O' AND l_orderkey % 3 = 0 THEN ' Ongoing' WHEN l_orderkey % 7 = 0 THEN 'Not Started'
            ELSE 'Completed' END AS status,
       CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE floor(l_extendedprice) / 99731e0 END AS estimated_lakh,
       floor(l_extendedprice * (1e0 - l_discount * (l_orderkey % 4))) / 99731e0 AS spent_lakh
FROM {lineitem}
"""

VIEWS["finance"] = """
SELECT o_custkey AS place_id, o_orderkey AS id,
       cast(year(o_orderdate) AS STRING) || '-' || substr(cast(year(o_orderdate) + 1 AS STRING), 3, 2) AS fin_year,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE floor(o_totalprice) END AS untied_receipts,
       floor(o_totalprice * 0.4e0) AS untied_payments, floor(o_totalprice * 0.3e0) AS tied_receipts,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE floor(o_totalprice * 0.1e0) END AS tied_payments
FROM {orders}
"""

VIEWS["employment"] = """
SELECT CASE WHEN o_custkey % 4 = 1 THEN -o_custkey ELSE o_custkey END AS place_id, o_orderkey AS id, cast(year(o_orderdate) AS STRING) AS fin_year,
       CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE floor(o_totalprice) / 99731e0 END AS total_lakh,
       floor(o_totalprice * 0.6e0) / 99731e0 AS wages_lakh, floor(o_totalprice * 0.4e0) / 99731e0 AS material_lakh
FROM {orders}
"""

VIEWS["water_tests"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_partkey * 0.75e0) AS BIGINT) AS place_id,
       CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS samples_tested,
       CAST(l_linenumber AS BIGINT) AS villages_not_tested
FROM {lineitem}
"""

VIEWS["stations"] = f"""
SELECT s_suppkey AS station_id, s_name AS station_name, {lat('s_suppkey * 5 + 7')} AS p_lat,
       {lon('s_suppkey * 5 + 7')} AS p_lon, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / -1000e0 END AS level_m,
       CASE s_suppkey % 4 WHEN 0 THEN 'falling' WHEN 1 THEN 'rising' WHEN 2 THEN NULL ELSE 'stable' END AS trend
FROM {{supplier}}
"""

VIEWS["readings"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS reading_id, 'Gauge ' || cast(l_suppkey AS STRING) AS gauge,
       l_suppkey AS station_id, {lat('l_suppkey * 7 + 3')} AS p_lat, {lon('l_suppkey * 7 + 3')} AS p_lon,
       l_quantity AS reading, l_shipdate AS shipped, e.ts AS observed_at
FROM {{lineitem}} JOIN {{events}} e ON e.event_id = l_orderkey
"""

VIEWS["alerts"] = """
SELECT event_id AS alert_id, CASE event_id % 5 WHEN 0 THEN 'Kolhapur' WHEN 1 THEN 'Nashik' WHEN 2 THEN 'Nashik,Kolhapur'
       WHEN 3 THEN '' ELSE NULL END AS districts,
       CASE event_id % 3 WHEN 0 THEN 'Heavy rain' WHEN 1 THEN 'Flood' ELSE NULL END AS event,
       ts AS effective, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + (event_id % 72) * INTERVAL '1' HOUR END AS expires
FROM {events} WHERE event_type = 'purchase'
"""

VIEWS["segments"] = f"""
SELECT p_partkey AS segment_id, p_partkey * 10 AS segment_code, 'L' || cast(p_partkey % 97 AS STRING) AS road_code,
       CASE WHEN p_partkey % 6 = 0 THEN '  ' ELSE 'Road ' || p_name END AS road_name,
       {lat('p_partkey * 3')} AS lat0, {lon('p_partkey * 3')} AS lon0,
       {lat('p_partkey * 3')} + 0.0021e0 AS lat1, {lon('p_partkey * 3')} + p_size / 10000e0 AS lon1,
       {lat('p_partkey * 3')} - 0.0013e0 AS lat2, {lon('p_partkey * 3')} + 0.006e0 AS lon2
FROM {{part}}
"""

VIEWS["floods"] = f"""
SELECT p_partkey AS box_id, CASE WHEN p_partkey % 2 = 0 THEN '2013' ELSE '2021' END AS flood_year,
       {lon('p_partkey * 11 + 5')} AS xmin, {lat('p_partkey * 11 + 5')} AS ymin,
       {lon('p_partkey * 11 + 5')} + p_size / 1000e0 AS xmax, {lat('p_partkey * 11 + 5')} + p_partkey % 40 / 1000e0 AS ymax
FROM {{part}}
"""


# Whole documents, each with a complaint added.
VIEWS["texts"] = """
SELECT d.doc_id AS id, d.text || '. ' || h.phrase AS body,
       CASE d.doc_id % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'water' WHEN 2 THEN 'health' WHEN 3 THEN 'education' ELSE NULL END AS category,
       d.doc_id % 9 AS duplicates, d.n_chars
FROM {documents} d JOIN {phrases} h ON h.k = d.doc_id % 19
"""

# Stored facts of one photo per document.
VIEWS["photo_rows"] = """
SELECT d.doc_id AS attachment_id, e.event_id AS report_id, e.user_id, 'V' || cast(e.user_id % 20 AS STRING) AS village,
       CASE WHEN d.doc_id % 3 = 0 THEN 'file_upload' ELSE 'live_camera' END AS capture_method,
       e.ts AS captured_at, e.ts + (d.doc_id % 200 - 15) * INTERVAL '1' MINUTE AS received_at,
       (d.n_chars % 41) / 40e0 AS pothole_confidence, (d.n_chars % 23) / 22e0 AS crack_confidence,
       d.n_chars % 4 <> 0 AS defect_seen,
       CASE d.doc_id % 5 WHEN 0 THEN 'crack' WHEN 1 THEN 'partial' WHEN 2 THEN 'collapse' ELSE NULL END AS damage_grade,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE (d.n_chars % 29) / 28e0 END AS damage_confidence,
       CASE d.doc_id % 4 WHEN 0 THEN 'bridge' WHEN 1 THEN 'building' ELSE NULL END AS damage_structure,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 0.2e0 + (d.n_chars % 81) / 100e0 END AS authenticity,
       CASE d.doc_id % 6 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'partly_verified' ELSE 'verified' END AS verdict,
       CASE d.doc_id % 5 WHEN 0 THEN 'reused_photo' WHEN 1 THEN 'no_capture_gps' WHEN 2 THEN 'editing_software' ELSE NULL END AS flag1,
       CASE d.doc_id % 3 WHEN 0 THEN 'not_live_capture' ELSE NULL END AS flag2, d.n_chars, d.text,
       (d.n_chars % 300) * 15040395481399 + d.doc_id % 6 * 4097 AS ph,
       (d.n_chars % 300) * 27303493102507 + d.doc_id % 10 * 65 AS dh,
       p.lat + (d.doc_id % 9) * 0.011e0 AS capture_lat, CASE WHEN d.doc_id % 10 = 3 THEN NULL ELSE p.lon END AS capture_lon,
       CASE WHEN d.doc_id % 4 = 1 THEN NULL ELSE d.doc_id % 16 * 100e0 END AS accuracy_m,
       CASE WHEN d.doc_id % 20 = 3 THEN p.lat END AS exif_lat, CASE WHEN d.doc_id % 20 = 3 THEN p.lon END AS exif_lon,
       p.lat AS village_lat, p.lon AS village_lon,
       CASE d.doc_id % 8 WHEN 0 THEN 'Adobe Photoshop' WHEN 1 THEN 'GIMP 2' ELSE NULL END AS software,
       (d.n_chars % 100) / 100e0 AS ela_score, (d.n_chars % 79) / 79e0 AS moire_score, d.doc_id % 17 = 0 AS static_burst,
       CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE TRUE END AS model_ran,
       CASE e.event_type WHEN 'view' THEN 'road' WHEN 'click' THEN 'water' ELSE 'health' END AS category
FROM {documents} d JOIN {events} e ON e.event_id = CAST(floor(d.doc_id / 2e0) AS BIGINT) * 3
JOIN {places} p ON p.id = e.user_id
"""

# Detection boxes, several per image, on a unit frame.
VIEWS["detections"] = """
SELECT l_orderkey AS image_id, l_orderkey * 10 + l_linenumber AS det_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'crack' ELSE 'pothole' END AS label,
       (l_partkey % 100) / 101e0 AS confidence, (l_suppkey * 7 % 80) / 100.7e0 AS x1, (l_partkey * 3 % 80) / 100.9e0 AS y1,
       (l_suppkey * 7 % 80) / 100.7e0 + l_quantity / 300.1e0 AS x2, (l_partkey * 3 % 80) / 100.9e0 + (l_partkey % 20) / 99.1e0 AS y2
FROM {lineitem}
"""

# One row per order: every input of the score, with the edge cases the terms distinguish.
VIEWS["inputs"] = """
SELECT o_orderkey AS id, o_orderkey % 40 - 2 AS reporters,
       CAST(floor(o_totalprice) AS BIGINT) % 150000 - 40 AS people, o_orderkey % 7 AS settlements,
       (o_orderkey % 101 - 3) / 100e0 AS confidence, (o_orderkey % 300) / 10e0 AS burst,
       CASE o_orderkey % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'water' WHEN 2 THEN 'health' WHEN 3 THEN 'education'
            ELSE 'other' END AS category,
       CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE NULL END AS severity,
       CASE WHEN o_orderkey % 9 = 0 THEN 'Peth' WHEN o_orderkey % 9 = 1 THEN 'Ajra' ELSE 'Kagal' END AS block,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 17) * 1e0 END AS record_age,
       CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE (o_orderkey * 7 % 120) / 100e0 - 0.1e0 END AS real_infra,
       CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE (o_orderkey * 3 % 100) / 100e0 END AS real_vulnerability,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_orderkey * 11 % 130) / 100e0 END AS reporting_deficit,
       CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderkey % 2 = 0 END AS eligible,
       CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE (o_orderkey % 60) * 1e0 END AS town_km,
       CASE WHEN o_orderkey % 16 = 1 THEN NULL ELSE (o_orderkey % 50) * 1e0 END AS hq_km,
       CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE (o_orderkey % 11) / 10e0 END AS road_share,
       (o_orderkey % 21) / 20e0 AS velocity, (o_orderkey % 31) / 30e0 AS high_share,
       CASE o_orderkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1 / 3e0 WHEN 2 THEN 2 / 3e0 ELSE 1e0 END AS grade,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'crack' WHEN 2 THEN 'partial' ELSE 'collapse' END AS grade_label,
       (o_orderkey % 13) / 10e0 AS grade_confidence
FROM {orders}
"""


def dependencies(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", VIEWS[name])))


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES or n in out:
            return
        for d in dependencies(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    parts = [f"{n} AS ({VIEWS[n].format_map(_Names())})" for n in _closure(list(names))]
    return "WITH RECURSIVE " + ", ".join(parts)


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


class Views:
    """The same views as DataFrames: ``Views(spark, sf_dir).reports``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        df = self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df

    def sql(self, text: str) -> DataFrame:
        needed = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))
        return self.spark.sql(text, **{n: getattr(self, n) for n in needed})
