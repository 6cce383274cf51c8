"""Photo facts: roll-ups, near-duplicates, verdicts."""

from __future__ import annotations

from itertools import combinations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.rounding import portable_round
from .ranking import sum_before
from .state import checkpoint

C = F.col


def grade_rank(grade: Column) -> Column:
    return F.when(grade == "crack", 1).when(grade == "partial", 2).when(grade == "collapse", 3).otherwise(0)


def rollup(photo_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts, trust, defects and the worst damage of the photos of each key."""
    checked = C("authenticity").isNotNull()
    defect = checked & F.coalesce("defect_seen", F.lit(False))
    graded = checked & (F.coalesce("damage_grade", F.lit("")) != "") & (
        F.coalesce("damage_structure", F.lit("")) != "")
    conf = F.coalesce("damage_confidence", F.lit(0.0))
    return photo_rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(C("capture_method") == "live_camera").alias("live_captures"),
        F.count_if(checked & (C("verdict") == "verified")).alias("verified"),
        F.count_if(checked & (C("verdict") == "needs_review")).alias("needs_review"),
        F.min("authenticity").alias("lowest_authenticity"), F.count("authenticity").alias("photos_checked"),
        F.count_if(defect).alias("showing_defect"),
        F.count_if(defect & (F.coalesce("verdict", F.lit("")) != "needs_review")).alias("trusted_defect"),
        F.coalesce(F.max(F.when(checked, C("pothole_confidence"))), F.lit(0.0)).alias("max_pothole"),
        F.coalesce(F.max(F.when(checked, C("crack_confidence"))), F.lit(0.0)).alias("max_crack"),
        F.max_by(
            F.when(graded, F.struct("damage_grade", "damage_structure", conf.alias("damage_confidence"))),
            F.when(graded, F.struct(grade_rank(C("damage_grade")), conf, -C("attachment_id")))).alias("worst"),
        F.count_if(graded).alias("photos_with_damage"))


def classifier_scores(scored: DataFrame, threshold: float) -> DataFrame:
    """Metrics of (label 0/1, score). AUC by rank sums over distinct scores: equal scores share their mean rank.

    The running sum is taken over distinct score values after aggregation, range by range.
    """
    hit = C("score") >= threshold
    n = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & (C("label") == 1)).alias("tp"),
        F.count_if(hit & (C("label") == 0)).alias("fp"), F.count_if(~hit & (C("label") == 0)).alias("tn"),
        F.count_if(~hit & (C("label") == 1)).alias("fn"))
    by_score = scored.groupBy("score").agg(
        F.count_if(C("label") == 1).alias("p"), F.count_if(C("label") == 0).alias("q"))
    auc = sum_before(by_score, [C("score")], C("q"), "below").agg(
        (F.sum(C("p") * (C("below") + C("q") * 0.5))
         / F.greatest(F.lit(1), F.sum("p") * F.sum("q"))).alias("auc"))

    def part(num: Column, den: Column) -> Column:
        return F.coalesce(portable_round(num / F.nullif(den, F.lit(0.0)), 4), F.lit(0.0))

    tp, fp, tn, fn = (C(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return n.withColumn("one", F.lit(1)).join(auc.withColumn("one", F.lit(1)), "one").select(
        "n", part(tp + tn, tp + fp + tn + fn).alias("accuracy"), part(tp, tp + fp).alias("precision"),
        part(tp, tp + fn).alias("recall"), part(tp * 2.0, tp * 2.0 + fp + fn).alias("f1"),
        portable_round(C("auc"), 4).alias("roc_auc"), "tp", "fp", "tn", "fn")


# ---- near-duplicates

SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Combinations of difference hashes under two near perceptual hashes that meet directly; beyond it they meet by segments.
CROWD = 1 << 26


def _flips(bits: int, most: int) -> Column:
    """All masks of a segment with at most ``most`` bits set."""
    masks = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return F.array(*[F.lit(m).cast("bigint") for m in masks])


def _segment(h: Column, start: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, start).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _meet(left: DataFrame, right: DataFrame, a: str, b: str, most: int, on: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs of rows whose hashes ``a`` and ``b`` differ in at most ``most`` bits, inside equal ``on``.

    Differing bits spread over three segments leave one segment with at most a third of them. Each side files every value
    within half of that of its segments, so two bits take one flip on either side.
    """
    slack = most // len(SEGMENTS)

    def filed(df: DataFrame, h: str, flips: int) -> DataFrame:
        def keys(n: int, start: int, bits: int) -> Column:
            return F.transform(_flips(bits, flips), lambda m: F.struct(
                F.lit(n).alias("_seg"), _segment(C(h), start, bits).bitwiseXOR(m).alias("_value")))

        all_keys = F.concat(*[keys(n, start, bits) for n, (start, bits) in enumerate(SEGMENTS)])
        return df.withColumn("_k", F.explode(all_keys)).select(*df.columns, "_k.*")

    pairs = filed(left, a, slack - slack // 2).join(filed(right, b, slack // 2), [*on, "_seg", "_value"])
    return pairs.filter(F.bit_count(C(a).bitwiseXOR(C(b))) <= most).drop("_seg", "_value").distinct()


def near_hashes(new: DataFrame, existing: DataFrame, cfg: Settings = DEFAULTS, crowd: int = CROWD) -> DataFrame:
    """Pairs of distinct hash pairs (ph, dh) x (q_ph, q_dh) within both distances.

    Perceptual hashes meet first, each once however many photos share it. Under two near ones the difference hashes meet
    directly, or by segments of their own where they have more than ``crowd`` combinations: a stock picture that half of
    the table shares with edits. Both ways are complete.
    """
    probe = new.select("ph", "dh").dropna().distinct()
    filed = existing.select(C("ph").alias("q_ph"), C("dh").alias("q_dh")).dropna().distinct()
    held = checkpoint(_meet(
        probe.groupBy("ph").agg(F.count(F.lit(1)).alias("_n")),
        filed.groupBy("q_ph").agg(F.count(F.lit(1)).alias("_m")), "ph", "q_ph", cfg.phash_max))
    few = held.filter(C("_n") * C("_m") <= crowd).select("ph", "q_ph").join(probe, "ph").join(filed, "q_ph").filter(
        F.bit_count(C("dh").bitwiseXOR(C("q_dh"))) <= cfg.dhash_max)
    crowded = held.filter(C("_n") * C("_m") > crowd).select("ph", "q_ph")
    many = _meet(crowded.join(probe, "ph"), crowded.join(filed, "q_ph"), "dh", "q_dh", cfg.dhash_max, ["ph", "q_ph"])
    cols = ["ph", "dh", "q_ph", "q_dh"]
    return few.select(*cols).unionByName(many.select(*cols)).withColumns({
        "phash_distance": F.bit_count(C("ph").bitwiseXOR(C("q_ph"))),
        "dhash_distance": F.bit_count(C("dh").bitwiseXOR(C("q_dh")))})


def duplicates(photo_rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per photo with a look-alike in another report: how many, the closest one, and the kind of reuse.

    ``photo_rows``: attachment_id, report_id, user_id, village, ph, dh. Counting and choosing run per distinct hash:
    each hash keeps its first photo and the first photo of any other report, which is all a closest match needs.
    """
    rows = photo_rows.filter("ph is not null and dh is not null").select(
        "attachment_id", "report_id", "user_id", "village", "ph", "dh")
    hashes = ["ph", "dh"]
    item = F.struct("attachment_id", "report_id", "user_id", "village")
    first = rows.groupBy(*hashes).agg(F.min_by(item, "attachment_id").alias("_a"), F.count(F.lit(1)).alias("_n"))
    second = rows.join(first.select(*hashes, "_a"), hashes).filter("report_id <> _a.report_id").groupBy(*hashes).agg(
        F.min_by(item, "attachment_id").alias("_b"))
    held = first.join(second, hashes, "left").withColumnsRenamed({"ph": "q_ph", "dh": "q_dh"})
    near = near_hashes(rows, rows, cfg)
    totals = near.join(held, ["q_ph", "q_dh"])
    per_hash = totals.groupBy(*hashes).agg(F.sum("_n").alias("_all"))
    # look-alikes inside a report are not reuse
    own = rows.groupBy(*hashes, "report_id").agg(F.count(F.lit(1)).alias("_own"))
    inside = near.join(own.select(*hashes, "report_id"), hashes).join(
        own.withColumnsRenamed({"ph": "q_ph", "dh": "q_dh"}), ["q_ph", "q_dh", "report_id"]).groupBy(
        *hashes, "report_id").agg(F.sum("_own").alias("_inside"))
    # best match of every (hash, report): the nearest hash whose first photo belongs to another report
    options = totals.join(own.select(*hashes, "report_id"), hashes)
    choice = F.when(C("_a.report_id") != C("report_id"), C("_a")).otherwise(C("_b"))
    best = options.withColumn("_m", choice).filter("_m is not null").groupBy(*hashes, "report_id").agg(
        F.min(F.struct("phash_distance", "dhash_distance", C("_m.attachment_id").alias("match_id"),
                       C("_m.report_id").alias("match_report"), C("_m.user_id").alias("match_user"),
                       C("_m.village").alias("match_village"))).alias("_best"))
    out = rows.join(per_hash, hashes).join(inside, [*hashes, "report_id"]).join(best, [*hashes, "report_id"])
    same_person = F.coalesce(C("user_id") == C("_best.match_user"), F.lit(False))
    same_place = F.lower(F.coalesce("village", F.lit(""))) == F.lower(F.coalesce("_best.match_village", F.lit("")))
    return out.select(
        "attachment_id", "report_id", (C("_all") - C("_inside")).alias("matches"), "_best.match_id",
        "_best.match_report", "_best.phash_distance", "_best.dhash_distance", same_person.alias("same_reporter"),
        same_place.alias("same_village"),
        F.when(same_person & same_place, "same_photo_resubmitted").otherwise("reused_photo").alias("duplicate_flag"))


# ---- capture, damage, verdict

def capture_checks(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Where, when and how a photo was taken, as flags."""
    from ..config import PHOTO_EARTH_KM
    from ..functions.dates import capture_age_flag, minutes_between
    from ..functions.geo import haversine_km, valid_coordinates
    from ..functions.text import edited_with_software

    live = F.coalesce(C("capture_method") == "live_camera", F.lit(False))
    own = C("capture_lat").isNotNull() & C("capture_lon").isNotNull()
    exif = ~own & C("exif_lat").isNotNull()
    lat = F.when(own, C("capture_lat")).when(exif, C("exif_lat"))
    lon = F.when(own, C("capture_lon")).when(exif, C("exif_lon"))
    ok = valid_coordinates(lat, lon)
    km = F.when(ok, portable_round(haversine_km(lat, lon, C("village_lat"), C("village_lon"), PHOTO_EARTH_KM), 3))
    precise = C("accuracy_m").isNull() | (C("accuracy_m") <= cfg.capture_max_accuracy_m)
    flags = F.array_compact(F.array(
        F.when(~live, "not_live_capture"), F.when(~ok, "no_capture_gps"),
        F.when(precise & (km > cfg.capture_max_km), "captured_far_from_village"),
        F.when(capture_age_flag(C("captured_at"), C("received_at"), live, cfg), "capture_time_mismatch"),
        F.when(edited_with_software(C("software")), "editing_software")))
    return rows.withColumns({
        "gps_source": F.when(ok & own, "capture_gps").when(ok & exif, "exif_gps"), "distance_km": km,
        "minutes_before_upload": portable_round(minutes_between(C("captured_at"), C("received_at")), 2),
        "capture_flags": flags})


def damage_grade(rows: DataFrame, text: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Damage grade from a stored image model answer (or the detector as a stand-in) and from wording.

    Reads model_grade, model_confidence, model_structure, model_ran, crack_confidence, pothole_confidence, strong_boxes,
    damage_area_pct.
    """
    from ..functions.text import photo_grade, photo_structure

    worded = photo_grade(C(text))
    modelled = C("model_grade").isNotNull()
    wide = F.coalesce((C("strong_boxes") >= 2) & (C("damage_area_pct") >= 20), F.lit(False))
    ran = F.coalesce("model_ran", F.lit(False))
    proxy = F.when(ran & wide, "partial").when(ran & (C("crack_confidence") >= cfg.defect_threshold), "crack")
    proxy_conf = F.when(wide, F.greatest("crack_confidence", "pothole_confidence")).otherwise(C("crack_confidence"))
    seen = F.coalesce("model_grade", proxy)
    image = (
        F.when(modelled, portable_round(C("model_confidence"), 3) * 0.55)
        .when(proxy.isNotNull(), portable_round(proxy_conf, 3) * 0.30).otherwise(0.0))
    words = F.when(worded.isNotNull(), 0.35).otherwise(0.0)
    both = F.when(seen.isNotNull() & worded.isNotNull(), 0.20).otherwise(0.0)
    rank = F.greatest(grade_rank(seen), grade_rank(worded))
    grade = F.when(rank == 3, "collapse").when(rank == 2, "partial").when(rank == 1, "crack")
    structure = F.coalesce(photo_structure(C(text)), F.when(modelled, C("model_structure")))
    return rows.withColumns({
        "structure": structure, "grade": grade, "photo_grade": seen, "wording_grade": worded,
        "grade_value": F.when(rank > 0, portable_round(rank / 3.0, 3)).otherwise(0.0),
        "damage_confidence": F.when(rank > 0, portable_round(F.least(F.lit(1.0), image + words + both), 3)).otherwise(0.0),
        "emergency_candidate": structure.isNotNull() & grade.isNotNull(),
        "collapse_confirmed_by_photo": F.coalesce(C("model_grade") == "collapse", F.lit(False))})


def authenticity(flags: Column, cfg: Settings = DEFAULTS) -> Column:
    """Product of what every flag leaves, with a floor."""
    from .. import vocab

    def left(flag: Column) -> Column:
        out = F.lit(1.0)
        for name, weight in vocab.FLAG_WEIGHTS.items():
            out = F.when(flag == name, 1.0 - weight).otherwise(out)
        return out

    kept = F.aggregate(flags, F.lit(1.0), lambda a, f: a * left(f))
    return portable_round(F.greatest(F.lit(cfg.authenticity_floor), kept), 3)


def verdicts(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Flags, authenticity, support, review list and verdict of a checked photo.

    Reads capture_flags, duplicate_flag, ela_score, moire_score, static_burst, category, model_ran, defect_seen,
    pothole_confidence, crack_confidence.
    """
    from .. import vocab

    ran = F.coalesce("model_ran", F.lit(False))
    road = C("category") == "road"
    flags = F.array_distinct(F.array_compact(F.concat("capture_flags", F.array(
        C("duplicate_flag"),
        F.when(F.coalesce("ela_score", F.lit(0.0)) >= cfg.ela_flag, "possibly_edited"),
        F.when(F.coalesce("moire_score", F.lit(0.0)) >= cfg.moire_flag, "screen_replay_suspected"),
        F.when(C("static_burst"), "static_burst"),
        F.when(road & ran & ~F.coalesce("defect_seen", F.lit(False)), "no_road_damage_seen")))))
    support = F.when(ran & road, portable_round(F.greatest(
        F.coalesce("pothole_confidence", F.lit(0.0)), F.coalesce("crack_confidence", F.lit(0.0))), 3))
    t = rows.withColumn("flags", flags)
    t = t.withColumns({
        "authenticity": authenticity(C("flags"), cfg), "support": support,
        "review_flags": F.array_sort(F.array_intersect("flags", F.array(*[F.lit(f) for f in vocab.REVIEW_FLAGS])))})
    trusted = (C("authenticity") >= 0.85) & (C("support").isNull() | (C("support") >= cfg.defect_threshold))
    return t.withColumn("verdict", F.when(trusted, "verified").when(F.size("review_flags") > 0, "needs_review")
                        .otherwise("partly_verified"))


def report_trust(checked: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Worst trust of a report's photos, its review flags and whether a verified photo supports it."""
    good = (C("verdict") == "verified") & (F.coalesce("support", F.lit(0.0)) >= cfg.defect_threshold)
    return checked.groupBy("report_id").agg(
        F.min("authenticity").alias("photo_trust"), F.bool_or(good).alias("supported"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("review_flags")))).alias("review_flags"))


GRID = 200
# Tasks of grid rows for one of other rows.
FINER = 8


def detection_rollup(detections: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Per image: best confidence per label, strong boxes, and the share of the frame they cover together.

    Boxes are on a unit frame. The covered share counts distinct cells of a 200 x 200 grid: one bitmap per grid row
    and image is combined with bit_or, so an image with many boxes stays 200 small rows.
    """
    d = detections.withColumns({
        "area": F.greatest(F.lit(0.0), (C("x2") - C("x1")) * (C("y2") - C("y1"))),
        "confidence": portable_round(C("confidence"), 4),
        **{c: portable_round(C(c), 4) for c in ("x1", "y1", "x2", "y2")}})
    counted = C("area") >= cfg.min_box_area
    strong = counted & (C("confidence") >= cfg.defect_threshold)

    def best(label: str) -> Column:
        return F.coalesce(F.max(F.when(counted & (C("label") == label), C("confidence"))), F.lit(0.0))

    sums = d.groupBy("image_id").agg(
        best("pothole").alias("pothole_confidence"), best("crack").alias("crack_confidence"),
        F.count_if(strong & (C("label") == "pothole")).alias("potholes"),
        F.count_if(strong & (C("label") == "crack")).alias("cracks"), F.bool_or(strong).alias("defect_seen"),
        F.count_if(~counted).alias("ignored_small_boxes"))

    def span(low: str, high: str) -> tuple[Column, Column]:
        first = F.floor(C(low) * GRID).cast("int")
        last = F.greatest(first + 1, F.floor(C(high) * GRID).cast("int"))
        return first, F.least(last, F.lit(GRID)) - 1

    r0, r1 = span("y1", "y2")
    c0, c1 = span("x1", "x2")
    boxes = d.filter(strong).select("image_id", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))
    # Boxes are dealt by image before they become grid rows, so what is shuffled is one small row per box. As a box becomes
    # up to 200 rows, they go to more tasks than rows of their size would.
    tasks = FINER * int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = boxes.filter("r0 <= r1 and c0 <= c1").repartition(tasks, "image_id").withColumn(
        "row", F.explode(F.sequence("r0", "r1")))
    # Each grid row is four words of fifty cells.
    words = []
    for k in range(4):
        low, high = F.greatest(C("c0") - 50 * k, F.lit(0)), F.least(C("c1") - 50 * k, F.lit(49))
        ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), high - low + 1) - F.lit(1)
        words.append(F.bit_or(F.when(low <= high, F.call_function("shiftleft", ones, low)).otherwise(
            F.lit(0).cast("bigint"))).alias(f"w{k}"))
    bitmap = rows.groupBy("image_id", "row").agg(*words)
    cells = bitmap.groupBy("image_id").agg(
        F.sum(sum((F.bit_count(f"w{k}") for k in range(1, 4)), F.bit_count("w0"))).alias("cells"))
    return sums.join(cells, "image_id", "left").withColumn(
        "damage_area_pct", portable_round(F.coalesce("cells", F.lit(0)) * 100.0 / (GRID * GRID), 1)).drop("cells")
