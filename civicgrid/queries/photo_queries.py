"""Stored photo facts: near-duplicates, capture checks, damage, verdicts."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import numeric
from ..operators import photos
from . import sqltext as S
from .registry import query
from .text_queries import lit

C = F.col

NEAR = """nearp AS (SELECT a.attachment_id, a.report_id, a.user_id, a.village, b.attachment_id AS match_id, b.report_id AS match_report,
  b.user_id AS match_user, b.village AS match_village, bit_count(xor(a.ph, b.ph)) AS dp, bit_count(xor(a.dh, b.dh)) AS dd
  FROM photo_rows a JOIN photo_rows b ON a.report_id <> b.report_id AND bit_count(xor(a.ph, b.ph)) <= 8 AND bit_count(xor(a.dh, b.dh)) <= 12),
dup AS (SELECT *, CASE WHEN coalesce(user_id = match_user, FALSE) AND lower(village) = lower(match_village) THEN 'same_photo_resubmitted'
  ELSE 'reused_photo' END AS duplicate_flag FROM (SELECT *, count(*) OVER (PARTITION BY attachment_id) AS matches,
  row_number() OVER (PARTITION BY attachment_id ORDER BY dp, dd, match_id) AS rn FROM nearp) x WHERE rn = 1)"""


@query("jon_20_near_duplicates", "JON-20", "attachment_id:i matches:i match_id:i phash_distance:i dhash_distance:i",
       f"WITH {NEAR} SELECT attachment_id, matches, match_id, dp AS phash_distance, dd AS dhash_distance FROM dup", "photo_rows")
def near_duplicates(v):
    return photos.duplicates(v.photo_rows)


@query("pip_12_duplicate_kind", "PIP-12", "attachment_id:i duplicate_flag:s same_reporter:b same_village:b match_report:i",
       f"""WITH {NEAR} SELECT attachment_id, duplicate_flag, coalesce(user_id = match_user, FALSE) AS same_reporter,
           lower(village) = lower(match_village) AS same_village, match_report FROM dup""", "photo_rows")
def duplicate_kind(v):
    return photos.duplicates(v.photo_rows)


_KM = "CASE WHEN la IS NOT NULL AND lo IS NOT NULL THEN " + S.rnd(S.hav("la", "lo", "village_lat", "village_lon", 6371.0088), 3) + " END"
_AGE = "(epoch_us(received_at) - epoch_us(captured_at)) / 60e6"
CAPTURE = f"""cap AS (SELECT *, CASE WHEN la IS NULL OR lo IS NULL THEN NULL WHEN own THEN 'capture_gps' ELSE 'exif_gps' END AS gps_source, {_KM} AS distance_km,
  {S.rnd(_AGE, 2)} AS minutes_before_upload, capture_method <> 'live_camera' AS f1, la IS NULL OR lo IS NULL AS f2,
  coalesce((accuracy_m IS NULL OR accuracy_m <= 1000) AND ({_KM}) > 5, FALSE) AS f3, {_AGE} > 120 OR {_AGE} < -10 AS f4,
  regexp_matches(coalesce(software, ''), {lit('(?i)' + V.EDITING_SOFTWARE)}) AS f5 FROM (
  SELECT *, capture_lat IS NOT NULL AND capture_lon IS NOT NULL AS own, CASE WHEN capture_lat IS NOT NULL AND capture_lon IS NOT NULL THEN capture_lat ELSE exif_lat END AS la,
  CASE WHEN capture_lat IS NOT NULL AND capture_lon IS NOT NULL THEN capture_lon ELSE exif_lon END AS lo FROM photo_rows) z)"""
_CAPFLAGS = """concat_ws(',', CASE WHEN f1 THEN 'not_live_capture' END, CASE WHEN f2 THEN 'no_capture_gps' END,
  CASE WHEN f3 THEN 'captured_far_from_village' END, CASE WHEN f4 THEN 'capture_time_mismatch' END, CASE WHEN f5 THEN 'editing_software' END)"""


@query("pip_11_capture_checks", "PIP-11", "attachment_id:i gps_source:s distance_km:d minutes_before_upload:d flags:s",
       f"WITH {CAPTURE} SELECT attachment_id, gps_source, distance_km, minutes_before_upload, {_CAPFLAGS} AS flags FROM cap", "photo_rows")
def capture(v):
    return photos.capture_checks(v.photo_rows).withColumn("flags", F.array_join("capture_flags", ","))


def checked(v):
    rows = photos.capture_checks(v.photo_rows.drop("authenticity", "verdict"))
    dup = photos.duplicates(v.photo_rows).select("attachment_id", "duplicate_flag")
    return photos.verdicts(rows.join(dup, "attachment_id", "left"))


def w(flag: str, test: str) -> str:
    return f"CASE WHEN {test} THEN {1 - V.FLAG_WEIGHTS[flag]}e0 ELSE 1e0 END"


_TEST = {
    "not_live_capture": "f1", "no_capture_gps": "f2", "captured_far_from_village": "f3", "capture_time_mismatch": "f4",
    "editing_software": "f5", "reused_photo": "coalesce(duplicate_flag = 'reused_photo', FALSE)",
    "screen_replay_suspected": "moire_score >= 0.6e0", "static_burst": "static_burst",
}
_KEEP = " * ".join(w(f, t) for f, t in _TEST.items())
VERDICT = f"""{NEAR}, {CAPTURE}, judged AS (SELECT *, CASE WHEN model_ran AND category = 'road' THEN {S.rnd('greatest(pothole_confidence, crack_confidence)', 3)} END AS sup,
  {S.rnd(f'greatest(0.2e0, {_KEEP})', 3)} AS auth,
  concat_ws(',', CASE WHEN f3 THEN 'captured_far_from_village' END, CASE WHEN f5 THEN 'editing_software' END, CASE WHEN duplicate_flag = 'reused_photo' THEN 'reused_photo' END,
    CASE WHEN moire_score >= 0.6e0 THEN 'screen_replay_suspected' END, CASE WHEN static_burst THEN 'static_burst' END) AS review
  FROM cap LEFT JOIN (SELECT attachment_id, duplicate_flag FROM dup) d USING (attachment_id)),
final AS (SELECT *, CASE WHEN auth >= 0.85e0 AND (sup IS NULL OR sup >= 0.25e0) THEN 'verified' WHEN review <> '' THEN 'needs_review' ELSE 'partly_verified' END AS vd FROM judged)"""
_ALLFLAGS = f"""concat_ws(',', nullif({_CAPFLAGS}, ''), duplicate_flag, CASE WHEN ela_score >= 0.55e0 THEN 'possibly_edited' END,
  CASE WHEN moire_score >= 0.6e0 THEN 'screen_replay_suspected' END, CASE WHEN static_burst THEN 'static_burst' END,
  CASE WHEN category = 'road' AND model_ran AND NOT defect_seen THEN 'no_road_damage_seen' END)"""


@query("num_20_authenticity", "NUM-20", "attachment_id:i authenticity:d",
       f"WITH {VERDICT} SELECT attachment_id, auth AS authenticity FROM final", "photo_rows")
def authenticity(v):
    return checked(v)


@query("pip_14_photo_verdict", "PIP-14", "attachment_id:i flags:s authenticity:d support:d review_flags:s verdict:s",
       f"WITH {VERDICT} SELECT attachment_id, {_ALLFLAGS} AS flags, auth AS authenticity, sup AS support, review AS review_flags, vd AS verdict FROM final",
       "photo_rows")
def verdict(v):
    return checked(v).withColumns({
        "flags": F.array_join("flags", ","), "review_flags": F.array_join("review_flags", ",")})


@query("num_19_photo_confidence", "NUM-19", "report_id:i confidence:d photo_trust:d supported:b review_flags:s",
       f"""WITH {VERDICT}, t AS (SELECT report_id, min(auth) AS worst, bool_or(vd = 'verified' AND coalesce(sup, 0) >= 0.25e0) AS supported FROM final GROUP BY 1),
           fl AS (SELECT report_id, string_agg(DISTINCT f, ',' ORDER BY f) AS rf FROM (SELECT report_id, unnest(string_split(review, ',')) AS f FROM final WHERE review <> '') GROUP BY 1)
           SELECT l.id AS report_id, CASE WHEN l.confidence IS NULL OR t.worst IS NULL THEN l.confidence ELSE
             {S.rnd('least(1e0, greatest(l.confidence * 0.5e0, CASE WHEN worst >= 0.85e0 AND supported THEN l.confidence + (1 - l.confidence) * 0.25e0 ELSE l.confidence * (0.7e0 + 0.3e0 * worst) END))', 4)} END AS confidence,
             worst AS photo_trust, supported, CASE WHEN t.worst IS NOT NULL THEN coalesce(rf, '') END AS review_flags
           FROM located l LEFT JOIN t ON t.report_id = l.id LEFT JOIN fl ON fl.report_id = l.id""", "photo_rows located")
def photo_confidence(v):
    trust = photos.report_trust(checked(v))
    out = v.located.select(C("id").alias("report_id"), "confidence").join(trust, "report_id", "left")
    return out.withColumns({
        "confidence": numeric.photo_confidence(C("confidence"), C("photo_trust"), C("supported")),
        "review_flags": F.array_join("review_flags", ",")})


_T = "coalesce(text, '')"


def _re(p: str) -> str:
    return f"regexp_matches({_T}, {lit('(?i)' + p)})"


_WORDED = "CASE " + " ".join(f"WHEN {_re(V.PHOTO_GRADE[g])} THEN {n}" for g, n in (("collapse", 3), ("partial", 2), ("crack", 1))) + " ELSE 0 END"
_STRUCT = f"CASE WHEN {_re(V.PHOTO_STRUCTURE['bridge'])} THEN 'bridge' WHEN {_re(V.PHOTO_STRUCTURE['building'])} THEN 'building' WHEN model_grade IS NOT NULL THEN damage_structure END"


@query("pip_13_damage_grade", "PIP-13", "attachment_id:i structure:s grade:s confidence:d emergency_candidate:b photo_grade:s wording_grade:s",
       f"""SELECT attachment_id, structure, CASE greatest(seen, worded) WHEN 3 THEN 'collapse' WHEN 2 THEN 'partial' WHEN 1 THEN 'crack' END AS grade,
           CASE WHEN greatest(seen, worded) = 0 THEN 0 ELSE {S.rnd('least(1e0, image + CASE WHEN worded > 0 THEN 0.35e0 ELSE 0e0 END + CASE WHEN worded > 0 AND seen > 0 THEN 0.2e0 ELSE 0e0 END)', 3)} END AS confidence,
           structure IS NOT NULL AND greatest(seen, worded) > 0 AS emergency_candidate,
           CASE seen WHEN 3 THEN 'collapse' WHEN 2 THEN 'partial' WHEN 1 THEN 'crack' END AS photo_grade,
           CASE worded WHEN 3 THEN 'collapse' WHEN 2 THEN 'partial' WHEN 1 THEN 'crack' END AS wording_grade
           FROM (SELECT *, {_WORDED} AS worded, {_STRUCT} AS structure,
             CASE WHEN model_grade IS NOT NULL THEN CASE model_grade WHEN 'crack' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END
                  WHEN model_ran AND wide THEN 2 WHEN model_ran AND crack_confidence >= 0.25e0 THEN 1 ELSE 0 END AS seen,
             CASE WHEN model_grade IS NOT NULL THEN 0.55e0 * {S.rnd('model_confidence', 3)}
                  WHEN model_ran AND wide THEN 0.3e0 * {S.rnd('greatest(crack_confidence, pothole_confidence)', 3)}
                  WHEN model_ran AND crack_confidence >= 0.25e0 THEN 0.3e0 * {S.rnd('crack_confidence', 3)} ELSE 0e0 END AS image
           FROM (SELECT *, CASE WHEN damage_confidence IS NULL THEN NULL ELSE damage_grade END AS model_grade, damage_confidence AS model_confidence,
                 n_chars % 3 >= 2 AND n_chars % 50 >= 20 AS wide FROM photo_rows) a) b""", "photo_rows")
def damage(v):
    rows = v.photo_rows.withColumns({
        "model_grade": F.when(C("damage_confidence").isNotNull(), C("damage_grade")),
        "model_confidence": C("damage_confidence"), "model_structure": C("damage_structure"),
        "strong_boxes": C("n_chars") % 3, "damage_area_pct": (C("n_chars") % 50).cast("double")})
    out = photos.damage_grade(rows, "text").drop("confidence")
    return out.withColumn("confidence", C("damage_confidence"))


_IN = "(confidence >= 0.25e0 AND area >= 0.005e0)"


@query("pip_15_detection_rollup", "PIP-15",
       "image_id:i pothole_confidence:d crack_confidence:d potholes:i cracks:i defect_seen:b ignored_small_boxes:i damage_area_pct:d",
       f"""WITH d AS (SELECT image_id, label, {S.rnd('confidence', 4)} AS confidence, greatest(0e0, (x2 - x1) * (y2 - y1)) AS area,
             {', '.join(S.rnd(c, 4) + ' AS ' + c for c in ('x1', 'y1', 'x2', 'y2'))} FROM detections),
           s AS (SELECT image_id, coalesce(max(confidence) FILTER (label = 'pothole' AND area >= 0.005e0), 0) AS pothole_confidence,
             coalesce(max(confidence) FILTER (label = 'crack' AND area >= 0.005e0), 0) AS crack_confidence,
             count(*) FILTER (label = 'pothole' AND {_IN}) AS potholes, count(*) FILTER (label = 'crack' AND {_IN}) AS cracks,
             bool_or({_IN}) AS defect_seen, count(*) FILTER (area < 0.005e0) AS ignored_small_boxes FROM d GROUP BY 1),
           b AS (SELECT image_id, CAST(floor(y1 * 200) AS INT) AS r0, greatest(CAST(floor(y1 * 200) AS INT) + 1, CAST(floor(y2 * 200) AS INT)) AS r1,
             CAST(floor(x1 * 200) AS INT) AS c0, greatest(CAST(floor(x1 * 200) AS INT) + 1, CAST(floor(x2 * 200) AS INT)) AS c1 FROM d WHERE {_IN}),
           r AS (SELECT image_id, unnest(range(r0, least(r1, 200))) AS y, c0, c1 FROM b),
           u AS (SELECT image_id, count(*) AS cells FROM (SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, unnest(range(c0, least(c1, 200))) AS x FROM r) q) p GROUP BY 1)
           SELECT s.*, {S.rnd('coalesce(u.cells, 0) * 100e0 / 40000', 1)} AS damage_area_pct FROM s LEFT JOIN u USING (image_id)""", "detections")
def detections(v):
    return photos.detection_rollup(v.detections)
