import json

from pyspark.sql import functions as F

from civicgrid.sources import feeds, registers, sinks
from civicgrid.streaming import streams

C = F.col


def test_census_csv(spark, tmp_path):
    path = tmp_path / "census.csv"
    path.write_text(
        "Village.Name,Total.Population.of.Village,Tap.Water.Treated..Status.A,Govt.Primary.School..Status,"
        "X.If.not.available.9,Nearest.Town.Distance.from.Village\nBidri,1200,1,2,b,7.5\nNone,NA,2,1,x,\n")
    rows = registers.read_csv(spark, str(path))
    got = registers.census_amenities(rows).collect()
    assert (got[0].water_tap_treated, got[0].school_primary, got[0].school_primary_nearest_band) == (1, 0, "b")
    assert got[0].dist_nearest_town_km == 7.5 and got[1].dist_nearest_town_km is None and got[1].households is None
    assert [tuple(r) for r in registers.census_population(rows).collect()] == [("Bidri", 1200)]


def test_geojson_files(spark, tmp_path):
    doc = {"features": [
        {"properties": {"schcd": " 27 ", "schname": "ZP School", "vilname": " "}, "geometry": {"coordinates": [74.0, 16.0]}},
        {"properties": {"schcd": "28"}, "geometry": {"coordinates": [0, 16.0]}},
        {"properties": {"schcd": "29"}, "geometry": {"coordinates": [74.0]}}]}
    path = tmp_path / "schools.json"
    path.write_text(json.dumps(doc, indent=1))
    rows = registers.read_json(spark, str(path), registers.SCHOOL_FEATURES, lines=False)
    got = registers.school_register(rows, "Kolhapur").collect()
    assert len(got) == 1 and got[0].external_id == "27" and got[0].village is None and got[0].lat == 16.0


def test_alert_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<alert><identifier>X1</identifier><info><event>Flood</event><effective>2024-01-01T05:30:00+05:30</effective>"
        "<expires>2024-01-02T00:00:00Z</expires><area><areaDesc>Ghats of Nashik</areaDesc></area>"
        "<area><areaDesc>Pune</areaDesc></area></info></alert>", encoding="utf-8")
    got = feeds.alerts(feeds.read_alerts(spark, str(tmp_path / "a.xml"))).first()
    assert got.identifier == "X1" and got.districts == "Nashik" and got.area_desc == "Ghats of Nashik; Pune"
    assert str(got.effective) == "2024-01-01 00:00:00"


def test_versioned_table_is_repeatable(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    t.upsert(old, ["k"])
    for _ in range(2):
        t.upsert(new, ["k"])
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert len(t.versions()) == 3


def stream_in_parts(spark, tmp_path, rows, schema, parts=3):
    folder = tmp_path / "in"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).withColumn(
            "created_at", C("created_at").cast("timestamp_ntz")).write.mode("append").parquet(str(folder))
    typed = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.read.parquet(str(folder))


def test_burst_over_many_batches_equals_batch(spark, tmp_path):
    from civicgrid.operators.cluster import burst_ratio

    rows = [(i, f"g{i % 3}", f"text {i % 17}", f"2024-01-{1 + i % 28:02d} 0{i % 10}:00:00") for i in range(200)]
    live, batch = stream_in_parts(spark, tmp_path, rows, "id long, group_id string, raw_text string, created_at string")
    q = streams.run_log(streams.first_arrivals(live), str(tmp_path / "log"), str(tmp_path / "state"), "update")
    q.awaitTermination()
    log = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    now = "2024-01-29 00:00:00"
    got = {r.group_id: round(r.burst, 9) for r in streams.burst_from_arrivals(log, now).collect()}
    want = {r.group_id: round(r.burst, 9) for r in burst_ratio(batch, ["group_id"], now).collect()}
    assert got == want


def test_upsert_stream_keeps_the_newest_row(spark, tmp_path):
    rows = [(i % 5, float(i), f"2024-01-{1 + (i * 7) % 28:02d} 00:00:00") for i in range(40)]
    live, batch = stream_in_parts(spark, tmp_path, rows, "k int, value double, created_at string")
    streams.start_upsert(live, str(tmp_path / "t"), ["k"], ["created_at", "value"], str(tmp_path / "s")).awaitTermination()
    got = {r.k: r.value for r in sinks.VersionedTable(spark, str(tmp_path / "t")).read().collect()}
    want = {r.k: r.v for r in batch.groupBy("k").agg(F.max_by("value", F.struct("created_at", "value")).alias("v")).collect()}
    assert got == want


def test_councils_of_one_name_keep_their_own_status(spark):
    # the status of one council was given to every other of its name in the block
    st = spark.createDataFrame([("Nashik", "Peth", "Bidri", "Down", 1)], "district string, block string, gp string, status string, code int")
    loc = spark.createDataFrame([("Nashik", "Peth", "Bidri", "20.1", "73.9", 1), ("Nashik", "Peth", "Bidri", "20.2", "73.9", 2)],
                                "district string, block string, gp string, lat string, lon string, code int")
    assert {(r.lat, r.status) for r in registers.fibre_nodes(st, loc, "code").collect()} == {(20.1, "Down"), (20.2, None)}
    assert {r.status for r in registers.fibre_nodes(st, loc).collect()} == {"Down"}
