from pyspark.sql import functions as F

from civicgrid.operators import cluster, photos
from civicgrid.plans import assets, invest, repair, structure, villages, views

C = F.col
REPORT = ("id long, issue_category string, district string, block string, village string, lat double, lon double,"
          " precise_lat double, precise_lon double, pin_source string, facility_id long, is_synthetic boolean")
FACILITY = ("id long, name string, external_id string, source string, category string, sub_type string, management string,"
            " village string, p_lat double, p_lon double")
PLACE = "id long, name string, district string, block string, population long, admin_level string, lat double, lon double"
STEP = 1 / 111194.9


def tables(spark, reports):
    rep = spark.createDataFrame(reports, REPORT)
    fac = spark.createDataFrame([
        (11, "School A", "A1", "udise", "education", "Primary", None, "Bidri", 16.0, 74.0),
        (12, "School B", "B1", "udise", "education", "Primary", None, "Bidri", 16.01, 74.0),
        (21, "PHC", "P1", "nic_healthgis", "health", "PHC", "Government", "Bidri", 16.05, 74.0)], FACILITY)
    places = spark.createDataFrame([
        (1, "Bidri", "Kolhapur", "Kagal", 5000, "village", 16.0, 74.0),
        (2, "Murgud", "Kolhapur", "Kagal", 9000, "village", 16.04, 74.0)], PLACE)
    works = spark.createDataFrame(
        [(1, 2, "Murgud road", 900, "In Progress", 2019, 10.0, 2.0)],
        "work_id long, place_id long, work_name string, external_id long, status string, sanction_year int,"
        " cost_lakh double, length_km double")
    seg = spark.createDataFrame(
        [(1, 77, "L1", "Kagal road", [(16.2, 74.0), (16.2, 74.1)], 16.2, 16.2, 74.0, 74.1)],
        "segment_id long, segment_code long, road_code string, road_name string,"
        " points array<struct<lat:double,lon:double>>, min_lat double, max_lat double, min_lon double, max_lon double")
    return rep, fac, places, works, seg


def r(i, cat, village="Bidri", lat=16.0, lon=74.0, pin=None, fac=None, source=None):
    return (i, cat, "Kolhapur", "Kagal", village, pin[0] if pin else lat, pin[1] if pin else lon,
            pin[0] if pin else None, pin[1] if pin else None, source or ("citizen_gps" if pin else None), fac, False)


def named(spark, reports):
    rep, fac, places, works, seg = tables(spark, reports)
    resolved = assets.resolve_assets(rep, fac, places)
    out = assets.name_assets(resolved, fac, places, works, seg)
    return {row.asset_id: row for row in out.collect()}


def test_five_rules_and_names(spark):
    got = named(spark, [
        r(1, "education", fac=11), r(2, "education", pin=(16.0 + 11 * STEP, 74.0)),
        r(3, "education", pin=(16.01, 74.0), fac=11), r(4, "health"), r(5, "education", lat=17.0),
        r(6, "road", "Murgud", 16.04), r(7, "water"), r(8, "road", "Bidri", pin=(16.2 + 21 * STEP, 74.05)),
        r(9, "health", lat=18.0)])
    assert got[1].name == "School A" and got[1].name_basis == "citizen_selected" and got[1].report_count == 3
    assert got[4].name == "PHC" and got[4].name_basis == "nearest_register"
    assert got[5].name == "School in Bidri (not specified)" and len(got[5].school_candidates) == 2
    assert got[6].name == "Murgud road" and got[6].name_basis == "pmgsy_work"
    assert got[7].name == "Water point near Bidri"
    assert got[8].name == "Kagal road" and got[8].name_basis == "geosadak_segment" and round(got[8].segment_m) == 21
    assert got[9].name == "Health facility in Bidri (not specified)"


def test_pins_split_work_by_distance(spark):
    far = named(spark, [r(1, "road", pin=(16.0, 74.0)), r(2, "road", pin=(16.0 + 400 * STEP, 74.0))])
    assert {a.name for a in far.values()} == {"Road near Bidri", "Road near Bidri #2"}
    assert len(named(spark, [r(1, "road", pin=(16.0, 74.0)), r(2, "road", pin=(16.0 + 100 * STEP, 74.0))])) == 1


def test_one_hospital_counts_for_two_villages(spark):
    rep, fac, places, works, seg = tables(spark, [r(1, "health"), r(2, "health", "Murgud", 16.04)])
    resolved = assets.resolve_assets(rep, fac, places)
    names = assets.name_assets(resolved, fac, places, works, seg)
    owned = resolved.join(names.select("asset_key", "asset_id"), "asset_key")
    scored = names.select("asset_id", F.lit(42.0).alias("priority_score"), F.lit(None).cast("string").alias("grade_label"),
                          F.lit(0.0).alias("grade_confidence"))
    out = {v.village: v for v in villages.village_priorities(owned, scored, places).collect()}
    assert names.count() == 1 and out["Bidri"].asset_count == out["Murgud"].asset_count == 1
    assert out["Bidri"].priority_score == 42.0 and out["Bidri"].counts_by_category == {"health": 1}


def test_mismatch_classes(spark):
    rep = spark.createDataFrame(
        [(i, "road", 16.0, 74.0) for i in range(3)] + [(9, "water", 16.5, 74.0), (10, "health", 16.5, 74.0)],
        "id long, issue_category string, lat double, lon double")
    places = spark.createDataFrame([(1, "A", "d", 16.0, 74.0), (2, "B", "d", 16.5, 74.0), (3, "C", "d", 16.01, 74.0)],
                                   "id long, name string, district string, lat double, lon double")
    works = spark.createDataFrame([(1, "Not Started", 5.0, 2015), (2, "In Progress", 7.0, None), (None, "Completed", 1.0, 2010)],
                                  "place_id long, status string, cost_lakh double, sanction_year int")
    fin = spark.createDataFrame([(1, 1, "2024", 100.0, 40.0, 10.0, None)],
                                "place_id long, id long, fin_year string, untied_receipts double, untied_payments double,"
                                " tied_receipts double, tied_payments double")
    got = {x.place_id: x for x in invest.village_investment(places, rep, works, fin).collect()}
    assert got[1].mismatch == "funded_undelivered" and got[1].unspent_rupees == 70.0
    assert got[2].mismatch == "funded_not_demanded" and got[2].nearby_reports == 0
    assert got[3].mismatch == "demanded_unfunded"
    assert invest.unpinned_works(works).first()[0] == 1


def test_identity_never_reaches_the_analytic_row(spark):
    rep, fac, places, _, _ = tables(spark, [r(1, "road")])
    forms = rep.select("id", "issue_category", "district", "block", "village", C("lat").alias("latitude"),
                       C("lon").alias("longitude"), "facility_id").withColumns({
        "raw_text": F.lit("my name is Asha, 9876543210"), "language": F.lit("en"), "severity": F.lit("low"),
        "location_raw": F.lit("x"), "picked_district": F.lit("Kolhapur"), "picked_block": F.lit("Kagal"),
        "picked_village": F.lit("Murgud"), "department": F.lit("pwd"), "report_lat": F.lit("16.05"),
        "report_lon": F.lit("74.0"), "confidence": F.lit(0.5),
        **{c: F.lit("secret") for c in structure.IDENTITY}})
    out = structure.resolve_intake(forms, places, fac)
    row = out.first()
    assert not set(structure.IDENTITY) & set(out.columns)
    assert row.raw_text == "my name is [NAME], [PHONE]" and row.village == "Murgud" and row.precise_lat == 16.05
    assert structure.identity_rows(forms).first().original_text.endswith("9876543210")


def test_pins_leave_coarsened(spark):
    a = spark.createDataFrame([(1, 16.123456, 74.0, "citizen_gps_pin", 1.0), (2, 16.123456, 74.0, "register_coordinates", 2.0)],
                              "asset_id long, lat double, lon double, location_basis string, priority_score double")
    o = spark.createDataFrame([(1, 5, 1), (2, 5, 2)], "id long, place_id long, asset_id long")
    got = {x.asset_id: x for x in views.village_detail(o, a).collect()}
    assert got[1].lat == 16.123 and got[2].lat == 16.123456 and got[2].rank_in_village == 1


def test_repair_fills_only_gaps(spark):
    _, _, places, _, _ = tables(spark, [])
    hq = spark.createDataFrame([(50, "Kagal", "Kolhapur", 16.02, 74.0)], "id long, name string, district string, lat double, lon double")
    rep = spark.createDataFrame(
        [(1, "the road near Murgud is broken", 0, "Kolhapur", None, None, None, None, None),
         (2, "tap dry", 0, "Kolhapur", "Kagal", "Bidri", "health", None, None)],
        "id long, raw_text string, duplicate_count int, district string, block string, village string,"
        " issue_category string, latitude double, longitude double")
    whole, fixed = repair.repair(places, hq, rep)
    got = {x.id: x for x in fixed.collect()}
    assert got[1].village == "Murgud" and got[1].issue_category == "road"
    assert got[2].village == "Bidri" and got[2].latitude == 16.0 and got[2].issue_category == "health"
    assert whole.filter("name = 'Kagal'").count() == 1


def test_worst_photo_damage_wins(spark):
    rows = [(1, 1, "live_camera", 0.3, 0.1, True, "crack", 0.9, "bridge", 0.9, "verified"),
            (2, 1, "file_upload", 0.2, 0.6, True, "collapse", 0.4, "bridge", 0.5, "needs_review"),
            (3, 1, "live_camera", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "attachment_id long, report_id long, capture_method string, pothole_confidence double,"
                                     " crack_confidence double, defect_seen boolean, damage_grade string, damage_confidence"
                                     " double, damage_structure string, authenticity double, verdict string")
    x = photos.rollup(df, ["report_id"]).first()
    assert (x.photos, x.photos_checked, x.verified, x.needs_review, x.trusted_defect) == (3, 2, 1, 1, 1)
    assert x.worst.damage_grade == "collapse" and x.lowest_authenticity == 0.5
