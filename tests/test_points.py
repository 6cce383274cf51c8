"""Rows that share points meet once per distinct point."""

import pytest

from civicgrid.operators import spatial
from civicgrid.plans import assets, invest, repair


@pytest.fixture
def met(monkeypatch):
    """Row counts of the sides of every distance join."""
    sizes, join = [], spatial.radius_join

    def counted(left, right, *args, **kwargs):
        sizes.append((left.count(), right.count()))
        return join(left, right, *args, **kwargs)

    for module in (spatial, assets, invest):
        monkeypatch.setattr(module, "radius_join", counted)
    return sizes


PLACES = [(i, 16.0 + i % 2, 74.0) for i in range(20)]


def test_nearest_within_meets_points_once(spark, met):
    # F16: every copy of a place met every copy of a station
    left = spark.createDataFrame(PLACES, "id int, lat double, lon double")
    right = spark.createDataFrame([(i, 16.01 + i % 2, 74.0, f"n{i}") for i in range(30, 10, -1)], "sid int, p_lat double, p_lon double, label string")
    got = {r.id: (r.sid, r.label) for r in spatial.nearest_within(left, right, 15.0, "id", ["sid"]).collect()}
    assert got == {i: (11, "n11") if i % 2 else (12, "n12") for i in range(20)}
    assert met == [(2, 2)]


def test_blocks_are_chosen_once_per_point(spark):
    # every copy of a place went through every headquarters of its district
    places = spark.createDataFrame([(i, "d", "old", 16.0 + i % 2, 74.0) for i in range(20)] + [(20, "d", "old", None, 74.0), (21, "e", "old", 16.0, 74.0)],
                                   "id int, district string, block string, lat double, lon double")
    hqs = spark.createDataFrame([(i, f"h{i}", "d", 16.1 + i % 2, 74.0) for i in range(9, -1, -1)], "id int, name string, district string, lat double, lon double")
    out = repair.assign_blocks(places, hqs)
    got = {r.id: r.block for r in out.collect()}
    assert got == {**{i: f"h{i % 2}" for i in range(20)}, 20: "h0", 21: "old"}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [district" in plan or "Distinct" in plan


def test_shortlist_meets_points_once(spark, met):
    # every copy of a point met every school, whatever the length of the list
    points = spark.createDataFrame(PLACES, "id int, lat double, lon double")
    schools = spark.createDataFrame([(i, f"s{i}", f"X{i}", "education", 16.0, 74.0) for i in range(50)],
                                    "id int, name string, external_id string, category string, p_lat double, p_lon double")
    got = {r.id: [c.facility_id for c in r.candidates] for r in assets.school_shortlist(points, schools, "id").collect()}
    assert got == {i: [0, 1, 2, 3, 4, 5] for i in range(0, 20, 2)}
    assert met == [(2, 6)]


def test_reports_near_meets_points_once(spark, met):
    # every copy of a school met every point with reports
    places = spark.createDataFrame(PLACES, "id int, p_lat double, p_lon double")
    reports = spark.createDataFrame([("education", 16.0, 74.0)] * 5 + [("road", 17.0, 74.0)], "issue_category string, lat double, lon double")
    got = {r.id: r.nearby_reports for r in invest.reports_near(places, reports, "education", "id").collect()}
    assert got == {i: 5 for i in range(0, 20, 2)}
    assert met == [(1, 2)]
