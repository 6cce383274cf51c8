"""Rows of one key or of many kinds stay spread over tasks and small until the step that needs them."""

from pyspark.sql import functions as F

from civicgrid.operators import emergency, photos
from civicgrid.plans.structure import accept_facility


def test_reports_without_a_facility_do_not_meet_in_one_task(spark):
    """a join on a key that most rows lack sends those rows to one task."""
    reports = spark.range(4000).select(
        "id", F.when(F.col("id") % 100 == 0, F.col("id") % 7).alias("facility_id"), F.lit("health").alias("issue_category"),
        F.lit(16.0).alias("v_lat"), F.lit(74.0).alias("v_lon"))
    facilities = spark.createDataFrame(
        [(0, "health", 16.0, 74.01), (1, "water", 16.0, 74.0), (2, "health", 17.0, 74.0)],
        "id long, category string, p_lat double, p_lon double")
    out = accept_facility(reports, facilities.hint("merge"))
    assert set(out.columns) == set(reports.columns)
    got = {r.id: r.facility_id for r in out.collect()}
    assert len(got) == 4000
    assert got == {i: 0 if i % 100 == 0 and i % 7 == 0 else None for i in range(4000)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        parts = accept_facility(reports, facilities).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in parts) < 1000


def test_boxes_are_shuffled_before_they_become_grid_rows(spark, capsys):
    """the shuffle carries a row per box, not one per box and grid row."""
    rows = [(1, "crack", 0.9, 0.0, 0.0, 0.5, 0.5), (1, "pothole", 0.8, 0.25, 0.25, 0.75, 0.75), (1, "crack", 0.9, 0.0, 0.0, 0.5, 0.5),
            (2, "crack", 0.1, 0.0, 0.0, 1.0, 1.0), (3, "pothole", 0.7, 0.9, 0.9, 1.4, 1.4)]
    d = spark.createDataFrame(rows, "image_id long, label string, confidence double, x1 double, y1 double, x2 double, y2 double")
    out = photos.detection_rollup(d)
    got = {r.image_id: (r.potholes, r.cracks, r.damage_area_pct) for r in out.collect()}
    assert got == {1: (1, 2, 43.8), 2: (0, 0, 0.0), 3: (1, 0, 1.0)}
    out.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(image_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "row#" in line]


def test_facilities_go_into_one_cell_each(spark, capsys):
    """of groups and facilities the few groups are copied over neighbouring cells, not the register."""
    from civicgrid.operators import cluster

    groups = spark.createDataFrame([(1, "health", 16.0, 74.0, "a"), (2, "road", 16.0, 74.0, "a"), (3, "health", 17.0, 74.0, "b")],
                                   "gid long, cat string, centroid_lat double, centroid_lon double, village string")
    facilities = spark.createDataFrame(
        [(7, "x", "X7", "nic", "health", "PHC", None, 16.01, 74.0), (8, "y", "X8", "nic", "health", "PHC", "z", 16.0, 74.03),
         (9, "w", "X9", "nic", "health", "PHC", "z", 17.0, 74.001), (5, "v", "X5", "nic", "health", "PHC", "z", 17.0, 73.985)],
        "id long, name string, external_id string, source string, category string, sub_type string, management string, p_lat double, p_lon double")
    works = spark.createDataFrame([], "village string, n_works long, works array<struct<name: string, external_id: string, detail: string, distance_m: long>>")
    out = cluster.name_work_groups(groups, "cat", facilities, works)
    got = {r.gid: (r.asset_label, [c.name for c in r.candidates or []]) for r in out.collect()}
    assert got == {1: ("x", ["x"]), 2: (None, []), 3: (None, ["w", "v"])}
    out.explain()
    generated = [line for line in capsys.readouterr().out.splitlines() if "Generate explode" in line]
    assert generated and not [line for line in generated if "external_id#" in line or "management#" in line]


def test_wordings_are_graded_once_and_over_all_tasks(spark, capsys):
    """the distinct texts stay a step of the plan, and the rules run behind their shuffle."""
    rows = [(1, "road", "the culvert has collapsed"), (1, "road", "the culvert has collapsed"), (1, "road", "the culvert has collapsed and was washed away"), (2, "water", None)]
    members = spark.createDataFrame(rows * 50, "group_id long, issue_category string, raw_text string").coalesce(1)
    out = emergency.wording(members, ["group_id"])
    got = {r.group_id: (r.word_rank, r.voices) for r in out.collect()}
    assert got == {1: (3, 2), 2: (0, 0)}
    out.explain("simple")
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_names_are_scored_once_per_pair_and_over_all_tasks(spark, capsys, monkeypatch):
    """a pair that meets on several letter pairs is scored behind the distinct step, in a shuffle that keeps its number of tasks."""
    from civicgrid.operators import fuzzy

    seen = []
    kept = fuzzy.checkpoint

    def checkpoint(df):
        if "score" in df.columns:
            seen.append(df)
        return kept(df)

    monkeypatch.setattr(fuzzy, "checkpoint", checkpoint)
    left = spark.createDataFrame([(1, "d", "kagalgaon"), (2, "d", "kagalgaom"), (3, "d", "xyz")], "id long, district string, name string")
    right = spark.createDataFrame([(7, "d", "kagalgaon"), (8, "d", "shirolwadi")], "id long, district string, name string")
    got = {r.id: r.match_id for r in fuzzy.best_match(left, right, 75.0).collect()}
    assert got == {1: 7, 2: 7}
    assert len(seen) == 1
    seen[0].explain("simple")
    plan = capsys.readouterr().out
    scored, dealt, distinct = plan.index("ArrowEvalPython"), plan.index("REPARTITION_BY_NUM"), plan.index("HashAggregate")
    assert scored < dealt < distinct
    assert plan.count("ArrowEvalPython") == 1


def test_reports_meet_the_alerts_of_their_own_day(spark, tmp_path):
    """state holds a day of a district as one block, not a row per alert, and late parts of an alert do not hide the others."""
    import random
    import uuid
    from datetime import datetime as D
    from datetime import timedelta

    from civicgrid.streaming import streams

    rng = random.Random(4)
    start = D(2024, 1, 1)
    reports = [(i if i % 13 else None, rng.choice(["a", "b", None]), start + timedelta(minutes=rng.randrange(4000))) for i in range(300)]
    reports += [(900, "a", start + timedelta(days=1)), (901, "a", start + timedelta(days=1) - timedelta(microseconds=1)), (902, "a", None)]
    alerts = []
    for i in range(120):
        at = start + timedelta(minutes=rng.randrange(4000))
        alerts.append((i if i % 17 else None, rng.choice(["a", "b", None]), at, at + timedelta(minutes=rng.choice([0, 30, 1440, 4000]))))
    alerts += [(500, "a", start, start + timedelta(days=1)), (501, "a", start + timedelta(hours=2), start), (502, "a", start, None)]

    def feed(rows, schema):
        path = str(tmp_path / uuid.uuid4().hex)
        d = spark.createDataFrame(rows, schema)
        half = len(rows) // 2
        spark.createDataFrame(rows[:half], schema).coalesce(1).write.parquet(path)
        spark.createDataFrame(rows[half:], schema).coalesce(1).write.mode("append").parquet(path)
        return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)

    r, r_stream = feed(reports, "id long, box_name string, created_at timestamp_ntz")
    a, a_stream = feed(alerts, "alert_id long, box_name string, effective timestamp_ntz, expires timestamp_ntz")
    want = sorted(
        ((i, k, t) for i, x, t in reports for k, y, since, till in alerts
         if None not in (x, t, till) and x == y and since <= t <= till), key=str)
    assert len(want) > 1000

    def rows(df):
        return sorted(((x.id, x.alert_id, x.created_at) for x in df.collect()), key=str)

    assert rows(streams.alerts_at_report(r, a)) == want
    found = streams.alerts_at_report(r_stream, a_stream, "4 days")
    base = str(tmp_path / "out")
    streams.run_log(found, base + "/log", base + "/state").awaitTermination()
    log = streams.BatchLog(spark, base + "/log").read(found.schema)
    assert rows(log) == want
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "Join" not in plan


def test_candidate_pairs_are_not_shuffled(spark, capsys):
    """a pair is found by distance or by name, not by both, so no step looks for repeats among all pairs."""
    from civicgrid.plans import views

    p = [(1, "Kagal", 16.0, 74.0), (2, " kagal", 17.0, 74.0), (3, "Peth", 16.03, 74.0), (4, "Kagal", None, 74.0), (5, None, 18.0, 74.0)]
    f = [(10, "a", "education", "x", "KAGAL ", 16.001, 74.0), (11, "b", "education", "x", "Other", 16.03, 74.001),
         (12, "c", "health", "y", "Kagal", 16.01, 74.0), (13, "d", "education", "x", "kagal", None, None)]

    def frames(p, f):
        return (spark.createDataFrame(p, "id long, name string, lat double, lon double"),
                spark.createDataFrame(f, "id long, name string, category string, sub_type string, village string, p_lat double, p_lon double"))

    def found(p, f):
        return sorted(((r.place_id, r.facility_id) for r in views.candidate_facilities(*frames(p, f)).collect()), key=str)

    want = sorted([(1, 10), (1, 12), (1, 13), (2, 10), (2, 13), (3, 11), (3, 12), (4, 10), (4, 13)])
    assert found(p, f) == want
    assert found(p + p, f + f) == want
    more = found([*p, (1, "Peth", 16.03, 74.0), (None, "Kagal", 16.0, 74.0), (None, "Kagal", 17.0, 74.0)], [*f, (12, "c", "health", "y", "q", 16.02, 74.0), (None, "a", "education", "x", "Peth", 17.0, 74.0)])
    assert len(set(more)) == len(more)
    assert set(more) == {*want, (1, 11), (None, 10), (None, 12), (None, 13), (3, None), (2, None), (1, None), (None, None)}
    capsys.readouterr()
    views.candidate_facilities(*frames(p, f)).explain()
    above = capsys.readouterr().out.split("Union")[0]
    assert "Aggregate" not in above and "Exchange" not in above


def test_segments_are_searched_once_per_point_and_over_all_tasks(spark, capsys):
    """keys at one point share the search, equal lines take part once, and few bytes do not become one task."""
    from civicgrid.operators import spatial

    def line(*p):
        return [{"lat": a, "lon": b} for a, b in p]

    one, two = line((16.0, 74.0), (16.0, 74.01)), line((16.01, 74.0), (16.01, 74.01))
    rows = [(5, one, "five", 16.0, 16.0, 74.0, 74.01), (3, one, "three", 16.0, 16.0, 74.0, 74.01), (4, two, "four", 16.01, 16.01, 74.0, 74.01)]
    segments = spark.createDataFrame(
        rows, "segment_id long, points array<struct<lat: double, lon: double>>, road string, min_lat double, max_lat double, min_lon double, max_lon double")
    points = spark.createDataFrame(
        [(1, 16.0005, 74.005), (2, 16.0005, 74.005), (3, 16.0099, 74.002), (4, 17.0, 74.0), (5, None, 74.0), (None, 16.0099, 74.002)],
        "id long, lat double, lon double")
    out = spatial.segments_near(points, segments, 150.0, "id")
    assert out.columns == ["id", "metres", "segment_id", "points", "road"]
    assert {r.id: (r.segment_id, r.road, len(r.points)) for r in out.collect()} == {
        1: (3, "three", 2), 2: (3, "three", 2), 3: (4, "four", 2), None: (4, "four", 2)}
    capsys.readouterr()
    spatial.segments_near(points, segments, 150.0, "id").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_centres_look_for_gauges_once_per_point_and_over_all_tasks(spark, capsys):
    """few bytes of centres that meet many gauges were one task."""
    from datetime import datetime as D

    from civicgrid.operators import hazards

    centres = spark.createDataFrame([(1, 16.0, 74.0), (2, 16.0, 74.0), (3, 16.1, 74.0), (3, 16.0, 74.0), (4, 20.0, 74.0), (5, None, 74.0), (None, 16.1, 74.0)],
                                    "group_id long, lat double, lon double")
    readings = spark.createDataFrame(
        [(1, "a", 16.01, 74.0, 1.0, D(2024, 1, 30)), (2, "a", 16.01, 74.0, 2.0, D(2024, 1, 30, 5)), (3, "b", 16.105, 74.0, 3.0, D(2024, 1, 30)),
         (4, "c", 16.0, 74.0, 4.0, D(2024, 1, 1))],
        "reading_id long, gauge string, p_lat double, p_lon double, reading double, observed_at timestamp_ntz")
    out = hazards.river_warnings(centres, readings, "2024-01-31 00:00:00")
    assert {r.group_id: (r.river_warnings, r.nearest_reading.gauge, r.nearest_reading.reading) for r in out.collect()} == {
        1: (3, "a", 2.0), 2: (3, "a", 2.0), 3: (6, "b", 3.0), None: (3, "b", 3.0)}
    capsys.readouterr()
    hazards.river_warnings(centres, readings, "2024-01-31 00:00:00").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
