"""NUM and GEO column functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import geo, numeric
from ..functions.rounding import portable_round
from . import sqltext as S
from .registry import query, register, scalar
from .views import lat, lon

C = F.col


def _inputs(*, infra="record_age", vuln="record_age"):
    names = ("reporters people settlements confidence category block hq_km velocity high_share real_infra"
             " real_vulnerability reporting_deficit eligible town_km road_share grade grade_label"
             " grade_confidence").split()
    cols = {n: C(n) for n in names}
    cols["infra_age"], cols["vuln_age"] = C(infra), C(vuln)
    cols["severity_mean"] = numeric.severity_value(C("severity"))
    return cols


scalar("num_01_demand", "NUM-01", "inputs", "id", {"demand:d": (lambda: numeric.demand_term(C("reporters")), S.DEMAND)})
scalar("num_02_population", "NUM-02", "inputs", "id",
       {"population:d": (lambda: numeric.population_term(C("people")), S.POPULATION)})
register(
    "num_03_severity_deficit", "NUM-03", "group_id:i deficit:d",
    lambda v: v.grouped.groupBy("group_id").agg(numeric.severity_deficit(C("severity")).alias("deficit")),
    f"SELECT group_id, avg({S.SEVERITY}) AS deficit FROM grouped GROUP BY group_id", "grouped")
scalar("num_04_settlement_proxy", "NUM-04", "inputs", "id",
       {"vulnerability:d": (lambda: numeric.settlement_proxy(C("people"), C("settlements")), S.SETTLEMENT)})
scalar("num_05_velocity", "NUM-05", "inputs", "id",
       {"velocity_term:d": (lambda: numeric.velocity_term(C("burst")), S.VELOCITY.replace("{r}", "burst"))})
scalar("num_06_record_freshness", "NUM-06", "inputs", "id",
       {"freshness:d": (lambda: numeric.record_freshness(C("record_age")), S.FRESH.replace("{a}", "record_age"))})
scalar("num_07_gap_score", "NUM-07", "inputs", "id", {"gap:d": (
    lambda: numeric.gap_score(
        numeric.demand_term(C("reporters")), numeric.population_term(C("people")),
        numeric.severity_value(C("severity")), numeric.settlement_proxy(C("people"), C("settlements"))),
    f"0.25e0 * ({S.DEMAND}) + 0.25e0 * ({S.POPULATION}) + 0.25e0 * ({S.SEVERITY}) + 0.25e0 * ({S.SETTLEMENT})")})
scalar("num_08_confidence_gate", "NUM-08", "inputs", "id", {
    "gate:d": (lambda: numeric.confidence_gate(C("confidence")), S.GATE),
    "gate_with_records:d": (
        lambda: numeric.confidence_gate(
            C("confidence"), C("real_infra").isNotNull() & C("real_vulnerability").isNotNull()),
        f"({S.GATE}) * CASE WHEN real_infra IS NULL OR real_vulnerability IS NULL THEN 0.85e0 ELSE 1e0 END")})
scalar("num_09_equity", "NUM-09", "inputs", "id",
       {"equity:d": (lambda: numeric.equity_term(C("reporting_deficit"), C("block")), S.EQUITY)})
scalar("num_10_strategic", "NUM-10", "inputs", "id", {"strategic:d": (
    lambda: numeric.strategic_term(C("eligible"), C("people"), C("settlements") * 1.0),
    f"({S.STRATEGIC}) + settlements * 1e0")})
scalar("num_11_urgency", "NUM-11", "inputs", "id",
       {"urgency:d": (lambda: numeric.urgency_term(C("grade"), C("grade_confidence")), S.URGENCY)})
scalar("num_12_feasibility", "NUM-12", "inputs", "id", {"feasibility:d": (
    lambda: numeric.feasibility_term(C("town_km"), C("road_share")),
    S.FEAS.replace("{d}", "town_km").replace("{s}", "road_share"))})
scalar("num_13_cost_penalty", "NUM-13", "inputs", "id",
       {"penalty:d": (lambda: numeric.cost_penalty(C("people")), S.PENALTY)})


def _weighted():
    from dataclasses import replace

    from ..config import DEFAULTS

    return replace(DEFAULTS, use_sector_weights=True)


scalar("num_14_category_importance", "NUM-14", "inputs", "id", {
    "importance_off:d": (lambda: numeric.category_importance(C("category")), "1e0"),
    "importance_on:d": (
        lambda: numeric.category_importance(C("category"), _weighted()),
        "CASE category WHEN 'health' THEN 1e0 WHEN 'education' THEN 1e0 WHEN 'water' THEN 0.2e0 / 0.3e0"
        " WHEN 'road' THEN 0.1e0 / 0.3e0 ELSE 0.225e0 / 0.3e0 END")})
scalar("num_15_trust_blend", "NUM-15", "inputs", "id", {
    "trust:d": (lambda: numeric.record_trust(C("record_age"), C("velocity"), C("high_share")), S.trust("record_age")),
    "infra:d": (
        lambda: numeric.trusted_value(
            C("real_infra"), numeric.severity_value(C("severity")),
            numeric.record_trust(C("record_age"), C("velocity"), C("high_share"))),
        S.blend("real_infra", S.SEVERITY, "record_age")),
    "vulnerability:d": (
        lambda: numeric.trusted_value(
            C("real_vulnerability"), numeric.settlement_proxy(C("people"), C("settlements")),
            numeric.record_trust(C("record_age"), C("velocity"), C("high_share"))),
        S.blend("real_vulnerability", S.SETTLEMENT, "record_age"))})

_BASIS = {
    "infra_basis": S.basis("real_infra", "record_age", "government_records", "severity", "proxy_reported_severity"),
    "vulnerability_basis": S.basis(
        "real_vulnerability", "record_age", "census_deprivation", "vulnerability", "proxy_settlement_size"),
    "equity_basis": "CASE WHEN reporting_deficit IS NULL THEN 'proxy_hardcoded_block_list' ELSE 'bharatnet_2022' END",
    "strategic_basis": "CASE WHEN eligible IS NULL THEN 'proxy_population_threshold' ELSE 'published_scheme_rule' END",
    "urgency_basis": f"CASE WHEN ({S.URGENCY}) > 0 THEN 'emergency_' || coalesce(grade_label, 'emergency') || ':' ||"
                     f" {S.pct('grade_confidence')} || '_confidence' ELSE 'no_emergency' END",
    "feasibility_basis": "CASE WHEN town_km IS NULL THEN 'computed_straight_line' ELSE 'census_recorded_distance' END",
}
_BASIS_TERM = {"infra_basis": "infra_deficit", "vulnerability_basis": "vulnerability", "equity_basis": "equity",
               "strategic_basis": "strategic", "urgency_basis": "urgency", "feasibility_basis": "feasibility"}
scalar("num_16_term_basis", "NUM-16", "inputs", "id", {
    f"{name}:s": ((lambda t=_BASIS_TERM[name]: numeric.data_basis(_inputs())[t]), text)
    for name, text in _BASIS.items()})

NINE = " ".join(f"{t}:d" for t in numeric.TERMS)


@query("num_17_nine_terms", "NUM-17", f"id:i {NINE} gap_score:d confidence_gate:d priority_score:d",
       S.score_sql("(SELECT *, record_age AS infra_age, record_age AS vuln_age FROM inputs) src", "id", S.SEVERITY),
       "inputs")
def nine_terms(v):
    cols = numeric.score_columns(_inputs())
    return v.inputs.select("id", *[c.alias(n) for n, c in cols.items()])


scalar("num_18_picked_location_confidence", "NUM-18", "inputs", "id", {"confidence_after:d": (
    lambda: numeric.picked_location_confidence(C("confidence")),
    S.rnd("least(1e0, confidence + (1 - confidence) * 0.5e0)", 2))})

# ---- GEO

_PAIR = f"""
SELECT e.event_id AS id, {lat('e.event_id')} AS lat1, {lon('e.event_id')} AS lon1,
       p.lat AS lat2, p.lon AS lon2 FROM {{events}} e JOIN {{places}} p ON p.id = e.user_id
"""
_PAIR_SQL = _PAIR.format(events="events", places="places")

register(
    "geo_01_haversine", "GEO-01", "id:i km:d photo_km:d",
    lambda v: v.sql(_PAIR).select(
        "id", geo.haversine_km(C("lat1"), C("lon1"), C("lat2"), C("lon2")).alias("km"),
        geo.haversine_km(C("lat1"), C("lon1"), C("lat2"), C("lon2"), 6371.0088).alias("photo_km")),
    f"SELECT id, {S.hav('lat1', 'lon1', 'lat2', 'lon2')} AS km,"
    f" {S.hav('lat1', 'lon1', 'lat2', 'lon2', 6371.0088)} AS photo_km FROM ({_PAIR_SQL}) pair", "places")

_BOXKM = S.hav("l.lat", "l.lon", "least(greatest(l.lat, f.ymin), f.ymax)", "least(greatest(l.lon, f.xmin), f.xmax)")
register(
    "geo_02_box_distance", "GEO-02", "id:i km:d",
    lambda v: v.located.join(v.floods, C("box_id") == C("id") % v.floods.count()).select(
        "id", geo.box_distance_km(C("lat"), C("lon"), C("xmin"), C("ymin"), C("xmax"), C("ymax")).alias("km")),
    f"SELECT l.id, {_BOXKM} AS km FROM located l JOIN floods f ON f.box_id = l.id % (SELECT count(*) FROM floods)",
    "located floods")
scalar("geo_04_near_box", "GEO-04", "floods", "box_id", {"near:b": (
    lambda: geo.near_box(F.lit(16.4), F.lit(74.2), C("ymin"), C("ymax"), C("xmin"), C("xmax"), 30.0),
    "16.4e0 BETWEEN ymin - 30 / 111e0 * 1.5e0 AND ymax + 30 / 111e0 * 1.5e0 AND 74.2e0 BETWEEN"
    " xmin - 30 / (111e0 * greatest(0.1e0, cos(radians(16.4e0)))) * 1.5e0 AND"
    " xmax + 30 / (111e0 * greatest(0.1e0, cos(radians(16.4e0)))) * 1.5e0")})
_M, _B = "(id % 500) * 1e0", "(id % 63) / 10e0"
scalar("geo_05_offset_point", "GEO-05", "places", "id", {
    "new_lat:d": (lambda: geo.offset_point(C("lat"), C("lon"), (C("id") % 500) * 1.0, (C("id") % 63) / 10.0)[0],
                  S.rnd(f"lat + {_M} * cos({_B}) / 111000e0", 7)),
    "new_lon:d": (lambda: geo.offset_point(C("lat"), C("lon"), (C("id") % 500) * 1.0, (C("id") % 63) / 10.0)[1],
                  S.rnd(f"lon + {_M} * sin({_B}) / (111000e0 * cos(radians(lat)))", 7))})
register(
    "geo_06_group_centroid", "GEO-06", "group_id:i c_lat:d c_lon:d",
    lambda v: v.grouped.groupBy("group_id").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon")),
    "SELECT group_id, avg(lat) AS c_lat, avg(lon) AS c_lon FROM grouped GROUP BY group_id", "grouped")


@query("geo_07_group_spread", "GEO-07", "group_id:i spread_m:d",
       "SELECT g.group_id, " + S.rnd("max(" + S.hav("c.lat", "c.lon", "g.lat", "g.lon") + ") * 1000", 1)
       + " AS spread_m FROM grouped g JOIN centres c USING (group_id) GROUP BY g.group_id", "grouped centres")
def group_spread(v):
    """Group centroid joined back to distinct member points: two aggregations, no window over a large group."""
    from ..operators.cluster import spread

    return spread(v.grouped, ["group_id"])


scalar("geo_08_public_coordinate", "GEO-08", "located", "id", {
    "public_lat:d": (
        lambda: geo.public_coordinate(
            C("lat"), F.when(C("id") % 4 == 0, "register_coordinates").when(C("id") % 4 == 1, "mixed")),
        f"CASE WHEN id % 4 = 0 THEN lat ELSE {S.rnd('lat', 3)} END")})
scalar("geo_09_box_tests", "GEO-09", "located", "id", {
    "in_kolhapur:b": (lambda: geo.in_box(C("lat"), C("lon"), (15.7, 17.1, 73.7, 74.7)),
                      "lat BETWEEN 15.7e0 AND 17.1e0 AND lon BETWEEN 73.7e0 AND 74.7e0"),
    "valid:b": (lambda: geo.valid_coordinates(C("precise_lat"), C("lon") * (C("id") % 5)),
                "coalesce(precise_lat BETWEEN -90 AND 90 AND lon * (id % 5) BETWEEN -180 AND 180, FALSE)")})
scalar("geo_10_effective_point", "GEO-10", "reports", "id", {
    "use_lat:d": (
        lambda: geo.effective_point(C("precise_lat"), C("precise_lon"), C("latitude"), C("longitude"))[0],
        "CASE WHEN precise_lat IS NOT NULL AND precise_lon IS NOT NULL THEN precise_lat ELSE latitude END"),
    "use_lon:d": (
        lambda: geo.effective_point(C("precise_lat"), C("precise_lon"), C("latitude"), C("longitude"))[1],
        "CASE WHEN precise_lat IS NOT NULL AND precise_lon IS NOT NULL THEN precise_lon ELSE longitude END")})

_PINS = """
SELECT r.id, CASE r.id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN 'NaN' ELSE cast(r.precise_lat AS STRING) END AS lat_text,
       cast(r.precise_lon + (r.id % 13) * 0.01e0 AS STRING) AS lon_text, r.latitude, r.longitude FROM {reports} r
"""
_PLAT = "CASE WHEN try_cast(lat_text AS DOUBLE) BETWEEN -90 AND 90 THEN try_cast(lat_text AS DOUBLE) END"
register(
    "geo_11_accepted_pin", "GEO-11", "id:i pin_lat:d pin_lon:d",
    lambda v: v.sql(_PINS).select(
        "id", *[c.alias(n) for n, c in zip(
            ("pin_lat", "pin_lon"),
            geo.accepted_pin(C("lat_text"), C("lon_text"), C("latitude"), C("longitude")))]),
    f"""SELECT id, CASE WHEN ok THEN a END AS pin_lat, CASE WHEN ok THEN b END AS pin_lon FROM (
        SELECT *, {S.hav('a', 'b', 'latitude', 'longitude')} <= 5 AS ok FROM (
        SELECT *, {_PLAT} AS a, try_cast(lon_text AS DOUBLE) AS b FROM ({_PINS.format(reports='reports')}) p) q) r""",
    "reports")


@query("geo_12_accepted_facility", "GEO-12", "id:i accepted_facility:i",
       f"""SELECT r.id, CASE WHEN f.category = r.issue_category AND
           {S.hav('r.latitude', 'r.longitude', 'f.p_lat', 'f.p_lon')} <= 10 THEN f.id END AS accepted_facility
           FROM reports r LEFT JOIN facilities f ON f.id = r.facility_id""", "reports facilities")
def accepted_facility(v):
    from ..plans.structure import accept_facility

    out = accept_facility(
        v.reports.withColumnsRenamed({"latitude": "v_lat", "longitude": "v_lon"}), v.facilities)
    return out.select("id", C("facility_id").alias("accepted_facility"))
