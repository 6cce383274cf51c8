"""TXT, DAT and JSN column functions over whole texts and tables."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import dates, nested, numeric, text
from . import sqltext as S
from .registry import query, register, scalar
from .views import AS_OF, AS_OF_SQL

C = F.col
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(words) -> str:
    import re

    return "|".join(re.escape(w) if w.isascii() else w for w in sorted(words, key=len, reverse=True))


def norm_sql(col: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    # RE2 has no look-around: the neighbours are captured, and a second pass takes words that shared a neighbour.
    x = col
    for _ in range(2):
        x = f"regexp_replace({x}, {lit(rf'(?i)(^|{edge})(?:{re2(V.FILLERS)})($|{edge})')}, '\\1 \\2', 'g')"
    for target in dict.fromkeys(V.SPELLINGS.values()):
        words = [w for w, r in V.SPELLINGS.items() if r == target]
        for _ in range(2):
            x = f"regexp_replace({x}, {lit(rf'(?i)(^|{edge})(?:{re2(words)})($|{edge})')}, '\\1{target}\\2', 'g')"
    x = f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')"
    return f"trim({x})"


def any_sql(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {lit(w.lower())})" for w in dict.fromkeys(words)) + ")"


def hits_sql(t: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {lit(w)}) AS INT)" for w in words) + ")"


def lang_sql(t: str) -> str:
    scripts = " ".join(f"WHEN regexp_matches({t}, '[{block}]') THEN '{code}'" for code, block in V.OTHER_SCRIPTS)
    deva = f"regexp_matches({t}, '[{V.DEVANAGARI}]')"
    return (
        f"CASE WHEN trim(coalesce({t}, '')) = '' THEN 'en' {scripts} WHEN {deva} AND regexp_matches({t}, '[a-zA-Z]{{2,}}') THEN 'mixed'"
        f" WHEN {deva} AND {hits_sql(t, V.MARATHI)} > {hits_sql(t, V.HINDI)} THEN 'mr-Deva' WHEN {deva} THEN 'hi-Deva'"
        f" WHEN {any_sql(f'lower({t})', V.HINDI_LATIN)} THEN 'hi-Latn' ELSE 'en' END")


def cat_sql(t: str) -> str:
    h = [hits_sql(f"lower({t})", [w.lower() for w in V.CATEGORY_WORDS[c]]) for c in ("road", "water", "health", "education")]
    r, w, he, e = h
    return (
        f"(SELECT CASE WHEN greatest(r, w, h, e) = 0 THEN NULL WHEN r = greatest(r, w, h, e) THEN 'road' WHEN w = greatest(r, w, h, e)"
        f" THEN 'water' WHEN h = greatest(r, w, h, e) THEN 'health' ELSE 'education' END FROM (SELECT {r} AS r, {w} AS w, {he} AS h, {e} AS e) q)")


def sev_sql(t: str, dup: str) -> str:
    low = f"lower({t})"
    return (f"CASE WHEN {any_sql(low, V.SEVERITY_HIGH)} OR coalesce({dup}, 0) > 5 THEN 'high'"
            f" WHEN {any_sql(low, V.SEVERITY_LOW)} THEN 'low' ELSE 'medium' END")


scalar("txt_01_normalize", "TXT-01", "texts", "id", {"clean:s": (lambda: text.normalize_text(C("body")), norm_sql("body"))})
scalar("txt_02_language", "TXT-02", "texts", "id", {
    "language:s": (lambda: text.detect_language(C("body")), lang_sql("body")),
    "supported:b": (
        lambda: text.supported_language(text.detect_language(C("body"))),
        f"({lang_sql('body')}) IN ('hi-Deva', 'mr-Deva', 'hi-Latn', 'mixed', 'en')")})
scalar("txt_03_category", "TXT-03", "texts", "id", {"found:s": (lambda: text.extract_category(C("body")), cat_sql("body"))})
scalar("txt_04_severity", "TXT-04", "texts", "id", {
    "severity:s": (lambda: text.extract_severity(C("body"), C("duplicates")), sev_sql("body", "duplicates"))})
register("txt_05_location_phrase", "TXT-05", "id:i phrase:s",
         lambda v: text.with_location_phrase(
             v.texts.select("id", text.normalize_text(C("body")).alias("clean")), "clean", "phrase"))

_SELF = text.self_naming("[A-Z][a-zA-Z]*", r"\b", r"\b")
REDACT = (f"regexp_replace(regexp_replace(regexp_replace(body, {lit(V.PHONE)}, '[PHONE]', 'g'), {lit(V.TITLED_NAME)}, '[NAME]', 'g'),"
          f" {lit(_SELF)}, '\\1\\2\\3 [NAME]', 'g')")
scalar("txt_06_redact", "TXT-06", "texts", "id", {"redacted:s": (lambda: text.redact(C("body")), REDACT)})


def label_sql(t: str, cat: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    bridge = any_sql(low, V.BRIDGE)
    return (
        f"CASE WHEN {low} = '' OR NOT ({bridge} OR {any_sql(low, V.BUILDING)} OR coalesce({cat} IN ('education', 'health'), FALSE))"
        f" OR (coalesce({cat} = 'road', FALSE) AND NOT {bridge}) THEN NULL WHEN {any_sql(low, V.COLLAPSE)} THEN 'collapse'"
        f" WHEN {any_sql(low, V.PARTIAL)} THEN 'partial' WHEN {any_sql(low, V.CRACK)} THEN 'crack' END")


scalar("txt_07_emergency_label", "TXT-07", "texts", "id", {
    "label:s": (lambda: text.emergency_label(C("body"), C("category")), label_sql("body", "category"))})


def _pm(pattern: str) -> str:
    return f"regexp_matches(coalesce(body, ''), {lit('(?i)' + pattern)})"


scalar("txt_08_photo_wording", "TXT-08", "texts", "id", {
    "structure:s": (lambda: text.photo_structure(C("body")),
                    f"CASE WHEN {_pm(V.PHOTO_STRUCTURE['bridge'])} THEN 'bridge' WHEN {_pm(V.PHOTO_STRUCTURE['building'])} THEN 'building' END"),
    "grade:s": (lambda: text.photo_grade(C("body")), "CASE " + " ".join(
        f"WHEN {_pm(V.PHOTO_GRADE[g])} THEN '{g}'" for g in ("collapse", "partial", "crack")) + " END")})

_END = """(CASE id % 7 WHEN 0 THEN 'MDR-' || cast(id AS STRING) || ' (' || name || ' Kh.)' WHEN 1 THEN 'SH ' || cast(id AS STRING)
  WHEN 2 THEN 'NH4A ' || name WHEN 3 THEN ' ' || name || ' - ' WHEN 4 THEN 'ab' WHEN 5 THEN cast(id AS STRING) || '.5' ELSE name END)"""
_PL = r"regexp_replace(CASE WHEN regexp_matches(v, '\([^)]+\)') THEN trim(regexp_extract(v, '\(([^)]+)\)', 1)) ELSE trim(regexp_replace(v, " \
      + lit(V.ROAD_PREFIX) + r", '')) END, '^[ .,\-–]+|[ .,\-–]+$', '', 'g')"
register(
    "txt_09_road_endpoint", "TXT-09", "id:i place:s",
    lambda v: v.places.select("id", text.road_endpoint_place(F.expr(_END)).alias("place")),
    f"""SELECT id, CASE WHEN p <> '' AND NOT regexp_matches(p, {lit(V.ROAD_REFERENCE)}) AND length(p) >= 3 THEN p END AS place
        FROM (SELECT id, {_PL} AS p FROM (SELECT id, trim({_END}) AS v FROM places) a) b""", "places")
scalar("txt_10_label_parts", "TXT-10", "places", "id", {
    "last_part:s": (lambda: text.last_path_part(F.concat_ws(" / ", "block", "district", "name")),
                    "trim(list_extract(string_split(block || ' / ' || district || ' / ' || name, '/'), -1))"),
    "head:s": (lambda: text.before_comma(F.concat(C("name"), F.lit(", "), C("district"))),
               "split_part(name || ', ' || district, ',', 1)")})
scalar("txt_11_name_filter", "TXT-11", "places", "id", {
    "has_wadi:b": (lambda: text.name_contains(C("name"), "WADI"), "contains(lower(name), 'wadi')"),
    "same_district:b": (lambda: text.same_name(C("district"), F.lit("nation_3")), "lower(district) = 'nation_3'")})
_FORM = """(SELECT id, CASE WHEN id % 7 = 0 THEN ' ' ELSE name END AS full_name,
  CASE id % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'x' ELSE NULL END AS gender,
  CASE WHEN id % 3 = 0 THEN '98' || cast(10000000 + id AS STRING) ELSE cast(id AS STRING) END AS mobile,
  CASE WHEN id % 5 = 0 THEN 'bad mail' ELSE name || '@mail.example' END AS email,
  CASE WHEN id % 6 = 0 THEN NULL ELSE 'Lane ' || cast(id AS STRING) END AS address,
  cast(416000 + id AS STRING) AS pincode, district, CASE WHEN id % 10 = 0 THEN '' ELSE block END AS block, name AS village,
  CASE id % 4 WHEN 0 THEN 'pwd' WHEN 1 THEN 'none' WHEN 2 THEN '' ELSE NULL END AS department FROM {places})"""
_FIELDS = "full_name gender mobile email address pincode district block village department".split()


def _blank(c):
    return f"trim(coalesce({c}, '')) = ''"


_ERRORS = [
    (_blank("full_name"), "Name is required"),
    ("coalesce(lower(trim(gender)), '') NOT IN ('male', 'female', 'transgender')", "Gender must be male, female or transgender"),
    (f"NOT regexp_matches(coalesce(mobile, ''), '{V.MOBILE}')", "Mobile must be 10 digits starting 6-9"),
    (f"NOT regexp_matches(coalesce(email, ''), '{V.EMAIL}')", "A valid e-mail address is required"),
    (_blank("address"), "Address is required"),
    (f"NOT regexp_matches(coalesce(pincode, ''), '{V.PINCODE}')", "Pincode must be 6 digits"),
    (_blank("district"), "District is required"), (_blank("block"), "Block is required"),
    (_blank("village"), "Village is required"),
    (f"NOT {_blank('department')} AND department NOT IN ({', '.join(lit(d) for d in V.DEPARTMENTS)})", "Unknown department"),
]
register(
    "txt_12_intake_errors", "TXT-12", "id:i errors:s",
    lambda v: v.sql("SELECT * FROM " + _FORM).select(
        "id", text.intake_errors({c: C(c) for c in _FIELDS}).alias("errors")),
    "SELECT id, nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN {lit(m)} END" for t, m in _ERRORS)
    + f"), '') AS errors FROM {_FORM.format(places='places')} f", "places")
_HEX = "lpad(lower(hex(({x}))), 16, '0')"
_HA, _HB = "vec_id * 1103515245 + 12345", "vec_id * 48271 + label * 7919"
register(
    "txt_14_hash_distance", "TXT-14", "vec_id:i bits:i",
    lambda v: v.embeddings.select("vec_id", text.hex_distance(
        F.expr(_HEX.replace("{x}", _HA)), F.expr(_HEX.replace("{x}", _HB))).alias("bits")),
    f"SELECT vec_id, bit_count(xor(CAST({_HA} AS BIGINT), CAST({_HB} AS BIGINT))) AS bits FROM embeddings")
_SOFT = "CASE id % 5 WHEN 0 THEN 'Adobe Photoshop ' || cast(id AS STRING) WHEN 1 THEN 'Screen Capture' WHEN 2 THEN 'Camera 2' WHEN 3 THEN 'paintXnet' ELSE NULL END"
register(
    "txt_15_editing_software", "TXT-15", "id:i edited:b",
    lambda v: v.places.select("id", text.edited_with_software(F.expr(_SOFT)).alias("edited")),
    f"SELECT id, regexp_matches(coalesce({_SOFT}, ''), '(?i){V.EDITING_SOFTWARE}') AS edited FROM places", "places")


def _conf_sql(lang: str, cat: str, sev: str, geo: str) -> str:
    table = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in V.LANGUAGE_CONFIDENCE.items())
    parts = [f"(CASE {lang} {table} ELSE 0.15e0 END)", f"(CASE WHEN {cat} IS NULL THEN 0.3e0 ELSE 0.9e0 END)",
             f"(CASE {sev} WHEN 'high' THEN 0.9e0 WHEN 'low' THEN 0.85e0 ELSE 0.7e0 END)", geo]
    mean = "(" + " + ".join(parts) + ") / 4"
    low = " + ".join(f"CASE WHEN {p} < 0.6e0 THEN 1 ELSE 0 END" for p in parts)
    return S.rnd(f"CASE WHEN {low} > 2 THEN {mean} * 0.9e0 ELSE {mean} END", 2)


_GEO = "(0.2e0 + (id % 77) / 100e0)"
scalar("txt_16_confidence", "TXT-16", "texts", "id", {"confidence:d": (
    lambda: text.overall_confidence([
        text.language_confidence(text.detect_language(C("body"))), text.category_confidence(C("category")),
        text.severity_confidence(text.extract_severity(C("body"), C("duplicates"))), F.lit(0.2) + (C("id") % 77) / 100.0]),
    _conf_sql(lang_sql("body"), "category", sev_sql("body", "duplicates"), _GEO))})
_DEP = "CASE id % 6 WHEN 0 THEN 'pwd' WHEN 1 THEN 'mjp' WHEN 2 THEN 'dho' WHEN 3 THEN 'deo' WHEN 4 THEN 'other' ELSE NULL END"
register(
    "txt_17_department_category", "TXT-17", "id:i use_category:s",
    lambda v: v.texts.select("id", F.coalesce(
        text.extract_category(C("body")), text.department_category(F.expr(_DEP))).alias("use_category")),
    f"""SELECT id, coalesce({cat_sql('body')}, CASE {_DEP} WHEN 'pwd' THEN 'road' WHEN 'mjp' THEN 'water' WHEN 'dho' THEN 'health'
        WHEN 'deo' THEN 'education' END) AS use_category FROM texts""", "texts")
_RAW = "CASE id % 6 WHEN 0 THEN cast(id AS STRING) || '.5 (' || cast(id % 90 AS STRING) || '&nbsp;%)' WHEN 1 THEN 'Rs ' || cast(id AS STRING) || ',000.25' WHEN 2 THEN '' WHEN 3 THEN ' ' || cast(id AS STRING) || ' ' WHEN 4 THEN 'x1' ELSE NULL END"
_AP = "trim(replace(replace({r}, '&nbsp;', ' '), '%', ''))".replace("{r}", _RAW)


def _grp(i: int) -> str:
    return f"try_cast(nullif(regexp_extract({_AP}, '^([0-9.]+)(?:\\s*\\(\\s*([0-9.]+)\\s*\\))?', {i}), '') AS DOUBLE)"


register(
    "txt_18_safe_casts", "TXT-18", "id:i as_int:i as_float:d as_bool:b loose:d digits:i amount:d percent:d",
    lambda v: v.places.select(
        "id", text.safe_int(F.expr(_RAW)).alias("as_int"), text.safe_float(F.expr(_RAW)).alias("as_float"),
        text.safe_bool(F.expr(_RAW)).alias("as_bool"), text.loose_number(F.expr(_RAW)).alias("loose"),
        text.digits_only(F.expr(_RAW)).alias("digits"), *[
            c.alias(n) for c, n in zip(text.amount_and_percent(F.expr(_RAW)), ("amount", "percent"))]),
    f"""SELECT id, CASE WHEN regexp_matches(trim({_RAW}), '^[+-]?[0-9]+$') THEN try_cast(trim({_RAW}) AS BIGINT) END AS as_int,
        try_cast(nullif(trim({_RAW}), '') AS DOUBLE) AS as_float,
        CASE WHEN regexp_matches(trim({_RAW}), '^[+-]?[0-9]+$') THEN try_cast(trim({_RAW}) AS BIGINT) END = 1 AS as_bool,
        try_cast(nullif(regexp_replace({_RAW}, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS loose,
        try_cast(nullif(regexp_replace({_RAW}, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits, {_grp(1)} AS amount, {_grp(2)} AS percent
        FROM places""", "places")

# ---- DAT

_ISO = """CASE id % 6 WHEN 0 THEN '2024-01-' || lpad(cast(id % 28 + 1 AS STRING), 2, '0') || 'T10:20:30Z'
  WHEN 1 THEN '2024-02-03T04:05:06+05:30' WHEN 2 THEN '2024-03-04 05:06:07' WHEN 3 THEN 'yesterday'
  WHEN 4 THEN '2024-05-06T07:08:09.250-02:00' ELSE NULL END"""
_UTC = """CASE id % 6 WHEN 0 THEN make_timestamp(2024, 1, id % 28 + 1, 10, 20, 30) WHEN 1 THEN TIMESTAMP '2024-02-02 22:35:06'
  WHEN 2 THEN TIMESTAMP '2024-03-04 05:06:07' WHEN 4 THEN TIMESTAMP '2024-05-06 09:08:09.25' END"""
register(
    "dat_01_utc_time", "DAT-01", "id:i micros:i",
    lambda v: v.places.select("id", dates.micros_between(dates.as_of("1970-01-01 00:00:00"), dates.utc_time(F.expr(_ISO))).alias("micros")),
    f"SELECT id, epoch_us({_UTC}) AS micros FROM places", "places")
_FLEX = """CASE id % 4 WHEN 0 THEN cast(1700000000 + id AS STRING) WHEN 1 THEN cast(1700000000123 + id AS STRING)
  WHEN 2 THEN '2024-02-03T04:05:06Z' ELSE 'never' END"""
register(
    "dat_02_flexible_time", "DAT-02", "id:i micros:i",
    lambda v: v.places.select("id", dates.micros_between(dates.as_of("1970-01-01 00:00:00"), dates.flexible_time(F.expr(_FLEX))).alias("micros")),
    """SELECT id, CASE id % 4 WHEN 0 THEN (1700000000 + id) * 1000000 WHEN 1 THEN (1700000000123 + id) * 1000
       WHEN 2 THEN epoch_us(TIMESTAMP '2024-02-03 04:05:06') END AS micros FROM places""", "places")
_AGE = "(epoch_us(received_at) - epoch_us(captured_at)) / 60e6"
_CAP = "CASE WHEN attachment_id % 8 = 0 THEN NULL ELSE captured_at END"
scalar("dat_03_capture_age", "DAT-03", "photo_rows", "attachment_id", {
    "minutes:d": (lambda: dates.minutes_between(C("captured_at"), C("received_at")), _AGE),
    "mismatch:b": (
        lambda: dates.capture_age_flag(
            F.when(C("attachment_id") % 8 != 0, C("captured_at")), C("received_at"), C("capture_method") == "live_camera"),
        f"CASE WHEN {_CAP} IS NULL THEN capture_method = 'live_camera' ELSE {_AGE} > 120 OR {_AGE} < -10 END")})
_SRC = "CASE id % 4 WHEN 0 THEN 'udise_2024_25_this_school' WHEN 1 THEN 'jal_jeevan_mission_current' ELSE NULL END"
_YT = "CASE WHEN id % 8 = 0 THEN 'year 20' || cast(10 + id % 12 AS STRING) || '-x' ELSE '2019x' END"
_OLD = "CASE WHEN id % 3 = 0 THEN 2000 + id % 20 END"
register(
    "dat_04_record_age", "DAT-04", "id:i infra_age:d vulnerability_age:d",
    lambda v: v.inputs.select(
        "id", dates.infra_record_age(C("category"), F.expr(_SRC), F.expr(_YT), F.expr(_OLD), F.lit(2024)).alias("infra_age"),
        dates.vulnerability_record_age(F.lit(2024)).alias("vulnerability_age")),
    f"""SELECT id, greatest(0, 2024 - CASE WHEN {_SRC} = 'udise_2024_25_this_school' THEN
          coalesce(try_cast(nullif(regexp_extract({_YT}, '\\b(20\\d{{2}})\\b', 1), '') AS INT), 2024)
          WHEN {_SRC} = 'jal_jeevan_mission_current' THEN 2024 WHEN category = 'road' AND {_OLD} IS NOT NULL THEN {_OLD} ELSE 2011 END) AS infra_age,
        13 AS vulnerability_age FROM inputs""", "inputs")
scalar("dat_05_time_windows", "DAT-05", "alerts", "alert_id", {
    "recent:b": (lambda: dates.since_hours(C("effective"), dates.as_of(AS_OF), 72.0), f"effective >= {AS_OF_SQL} - INTERVAL '72' HOUR"),
    "active:b": (lambda: dates.active_at(C("effective"), C("expires"), dates.as_of(AS_OF)),
                 f"coalesce(effective <= {AS_OF_SQL} AND expires >= {AS_OF_SQL}, FALSE)")})

# ---- JSN

_JS = """CASE WHEN event_id % 5 = 0 THEN '{{broken' ELSE '{{"infra": {{"cost": ' || cast(event_id AS STRING) || '.5}}, "p": ' || props || '}}' END"""
_JSV = _JS.replace("{{", "{").replace("}}", "}")
register(
    "jsn_01_nested_read", "JSN-01", "event_id:i cost:d k:d",
    lambda v: v.events.select(
        "event_id", nested.json_number(F.expr(_JSV), "$.infra.cost").alias("cost"),
        nested.json_number(F.expr(_JSV), "$.p.k", 0.0).alias("k")),
    f"""SELECT event_id, CASE WHEN json_valid(j) THEN try_cast(json_extract_string(j, '$.infra.cost') AS DOUBLE) END AS cost,
        coalesce(CASE WHEN json_valid(j) THEN try_cast(json_extract_string(j, '$.p.k') AS DOUBLE) END, 0) AS k
        FROM (SELECT event_id, {_JSV} AS j FROM events) q""")


@query("jsn_02_category_counts", "JSN-02", "place_id:i counts:s",
       """SELECT place_id, coalesce(string_agg(issue_category || '=' || cast(n AS VARCHAR), ',' ORDER BY issue_category), '') AS counts
          FROM (SELECT place_id, issue_category, count(*) AS n FROM located GROUP BY 1, 2) x GROUP BY place_id""", "located")
def category_counts(v):
    per = v.located.groupBy("place_id", "issue_category").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("place_id").agg(nested.map_text(nested.count_map(C("issue_category"), C("n"))).alias("counts"))


@query("jsn_03_children", "JSN-03", "report_id:i photos:s n:i",
       """SELECT l.id AS report_id, coalesce(string_agg(cast(attachment_id AS VARCHAR) || ':' || capture_method, ',' ORDER BY attachment_id), '') AS photos,
          count(attachment_id) AS n FROM located l LEFT JOIN photo_rows p ON p.report_id = l.id GROUP BY l.id""", "located photo_rows")
def children(v):
    kids = v.photo_rows.groupBy("report_id").agg(nested.ordered_children(
        C("attachment_id"), F.struct("attachment_id", "capture_method")).alias("photos"))
    text_ = F.array_join(F.transform("photos", lambda p: F.concat(
        p["attachment_id"].cast("string"), F.lit(":"), p["capture_method"])), ",")
    return v.located.select(C("id").alias("report_id")).join(kids, "report_id", "left").select(
        "report_id", F.coalesce(text_, F.lit("")).alias("photos"), F.coalesce(F.size("photos"), F.lit(0)).alias("n"))


@query("jsn_04_flag_union", "JSN-04", "report_id:i flags:s",
       """SELECT report_id, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS flags FROM (SELECT report_id, flag1 AS f FROM photo_rows
          UNION ALL SELECT report_id, flag2 FROM photo_rows) x GROUP BY report_id""", "photo_rows")
def flag_union(v):
    flags = F.array_compact(F.array("flag1", "flag2"))
    return v.photo_rows.groupBy("report_id").agg(F.array_join(nested.flag_union(flags), ",").alias("flags"))


@query("jsn_05_largest_villages", "JSN-05", "district:s largest:s",
       """SELECT district, string_agg(name || '=' || cast(population AS VARCHAR), ',' ORDER BY population DESC, id) AS largest FROM (
          SELECT *, row_number() OVER (PARTITION BY district ORDER BY population DESC, id) AS rn FROM places WHERE population > 0) x
          WHERE rn <= 5 GROUP BY district""", "places")
def largest(v):
    from ..operators.catchment import top_array

    out = top_array(v.places.filter("population > 0"), "district", [C("population").desc(), C("id")],
                    F.struct("name", "population"), 5, "top")
    return out.select("district", F.array_join(F.transform("top", lambda t: F.concat(
        t["name"], F.lit("="), t["population"].cast("string"))), ",").alias("largest"))


_PTS = "CASE WHEN segment_id % 9 = 0 THEN 'oops' ELSE '[[' || cast(segment_id AS STRING) || '.5, 74.25], [16.5, 74.5]]' END"
register(
    "jsn_06_polyline_text", "JSN-06", "segment_id:i n:i first_lat:d",
    lambda v: v.segments.select("segment_id", nested.polyline_from_text(F.expr(_PTS)).alias("p")).select(
        "segment_id", F.size("p").alias("n"), F.try_element_at("p", F.lit(1))["lat"].alias("first_lat")),
    """SELECT segment_id, CASE WHEN segment_id % 9 = 0 THEN 0 ELSE 2 END AS n,
       CASE WHEN segment_id % 9 = 0 THEN NULL ELSE segment_id + 0.5e0 END AS first_lat FROM segments""", "segments")
