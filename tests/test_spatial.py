import math
import random

import pytest
from pyspark.sql import functions as F

from civicgrid.operators import spatial

R = 6371.0


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, x)))


def points(n, lat0, seed):
    rnd = random.Random(seed)
    return [(i, lat0 + rnd.uniform(-0.3, 0.3), 74 + rnd.uniform(-0.3, 0.3)) for i in range(n)]


@pytest.mark.parametrize("lat0, radius", [(0.0, 3.0), (16.0, 8.0), (-41.0, 0.25), (68.0, 12.0)])
def test_radius_join_is_complete(spark, lat0, radius):
    a, b = points(150, lat0, 1), points(150, lat0, 2)
    left = spark.createDataFrame(a, "id int, lat double, lon double")
    right = spark.createDataFrame(b, "pid int, p_lat double, p_lon double")
    got = {(r.id, r.pid) for r in spatial.radius_join(left, right, radius).collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if hav(x, y, u, v) <= radius}
    assert got == want


def test_no_cross_product_is_planned(spark):
    left = spark.createDataFrame(points(20, 16, 1), "id int, lat double, lon double")
    right = spark.createDataFrame(points(20, 16, 2), "pid int, p_lat double, p_lon double")
    boxes = right.selectExpr("pid", "p_lon AS xmin", "p_lat AS ymin", "p_lon + 0.1 AS xmax", "p_lat + 0.1 AS ymax")
    for df in (spatial.radius_join(left, right, 5.0), spatial.box_join(left, boxes, 5.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_box_join_takes_boxes_of_any_size(spark):
    rnd = random.Random(5)
    pts = [(i, 16 + rnd.uniform(-2, 2), 74 + rnd.uniform(-2, 2)) for i in range(120)]
    boxes = []
    for j in range(60):
        size = rnd.choice([0.0, 0.01, 0.2, 3.0, 40.0])
        y, x = 16 + rnd.uniform(-2, 2), 74 + rnd.uniform(-2, 2)
        boxes.append((j, x, y, x + size, y + size))
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    b = spark.createDataFrame(boxes, "box int, xmin double, ymin double, xmax double, ymax double")
    got = {(r.id, r.box) for r in spatial.box_join(p, b, 5.0).collect()}
    want = {(i, j) for i, la, lo in pts for j, x0, y0, x1, y1 in boxes
            if hav(la, lo, min(max(la, y0), y1), min(max(lo, x0), x1)) <= 5.0}
    assert got == want


def test_nearest_without_a_cap_widens_its_rings(spark):
    left = spark.createDataFrame([(1, 16.0, 74.0), (2, -40.0, -60.0), (3, 16.2, 74.1)], "id int, lat double, lon double")
    right = spark.createDataFrame([(7, 16.01, 74.0), (8, 10.0, 20.0)], "hq int, p_lat double, p_lon double")
    got = {r.id: r.hq for r in spatial.nearest_any(left, right, "id", ["hq"]).collect()}
    want = {i: min([(hav(a, b, 16.01, 74.0), 7), (hav(a, b, 10.0, 20.0), 8)])[1]
            for i, a, b in [(1, 16.0, 74.0), (2, -40.0, -60.0), (3, 16.2, 74.1)]}
    assert got == want


def test_road_segment_distance(spark):
    line = [(1, [(16.0, 74.0), (16.0, 74.1)], 16.0, 16.0, 74.0, 74.1)]
    seg = spark.createDataFrame(
        line, "segment_id int, points array<struct<lat:double,lon:double>>, min_lat double, max_lat double, min_lon double,"
              " max_lon double")
    near = spark.createDataFrame([(1, 16.0 + 21 / 111139.0, 74.05), (2, 16.0 + 515 / 111139.0, 74.05)],
                                 "id int, lat double, lon double")
    assert [r.id for r in spatial.segments_near(near, seg, 150.0, "id").collect()] == [1]
    wide = {r.id: round(r.metres) for r in spatial.segments_near(near, seg, 600.0, "id").collect()}
    assert wide == {1: 21, 2: 515}
