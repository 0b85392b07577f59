import math
import random

import numpy as np

from lindwurm.operators import spatial


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * spatial.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_within_distance_equals_brute_force(spark):
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)] + [(200 + i, 10.0, 179.99) for i in range(40)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 91.0, 0.0), (903, 5.0, None)]
    centres = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180), rnd.choice([1e3, 1e6, 5e6, 2.1e7])) for i in range(20)] + [(50, 10.0, -179.99, 5000.0), (51, 90.0, 0.0, 2e6), (52, 0.0, 0.0, None), (53, 0.0, 0.0, -1.0)]
    p = spark.createDataFrame(points, "k int, la double, lo double")
    c = spark.createDataFrame(centres, "c int, y double, x double, r double").selectExpr("*", "'clash' as cell", "1 as salt")
    found = spatial.within_distance(p, c, key="k", lat="la", lon="lo", centre_key="c", centre_lat="y", centre_lon="x", radius_m="r", cell_rows=15)
    want = {(k, n) for k, a, b in points for n, y, x, r in centres if a is not None and b is not None and a == a and abs(a) <= 90 and r is not None and r >= 0 and metres(a, b, y, x) <= r}
    assert {tuple(r) for r in found.collect()} == want


def test_outlines_open_closed_and_either_direction(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rings = [(1, square), (2, square[::-1]), (3, [*square, square[0]]), (4, square[:2]), (5, None), (6, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])]
    outlines = spark.createDataFrame(rings, "z int, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("out", 1.0, 3.0), ("notch", 3.0, 2.0), ("in", 1.0, 1.0), ("none", None, 1.0)], "k string, la double, lo double")
    found = {tuple(r) for r in spatial.inside_outlines(points, outlines, key="k", lat="la", lon="lo", outline_key="z", ring="ring", cell_rows=1).collect()}
    assert found == {("in", 1), ("in", 2), ("in", 3), ("in", 6), ("out", 6)}


def test_empty_sides(spark):
    points = spark.createDataFrame([], "id string, geo_latitude double, geo_longitude double")
    zones = spark.createDataFrame([], "zone_id int, kind string, centre_lat double, centre_lon double, radius_m double, ring array<struct<lon:double,lat:double>>")
    assert spatial.zones_of_points(points, zones).count() == 0


def test_equal_positions_are_salted():
    same = np.tile(spatial.unit_vectors(np.array([48.0]), np.array([8.0])), (1000, 1))
    splits = spatial.KdSplits(same, 1000, 100)
    assert sum(splits.salts) >= 10 and set(splits.locate(same)) == {0}


def test_dense_centres_are_split_without_changing_the_result(spark):
    rnd = random.Random(8)
    rows = [(48 + rnd.random() / 50, 8 + rnd.random() / 50) for _ in range(120)] + [(48.0, 8.0)] * 30 + [(None, 8.0)]
    df = spark.createDataFrame(rows, "geo_latitude double, geo_longitude double")
    want = {(a, b): (rows.count((a, b)), sum(1 for c, d in rows if c is not None and (c, d) != (a, b) and metres(a, b, c, d) <= 400)) for a, b in rows if a is not None}
    for size in (7, 10_000):
        assert {(r["lat"], r["lon"]): (r["rows"], r["near"]) for r in spatial.neighbours(df, 400.0, cell_rows=size).collect()} == want
