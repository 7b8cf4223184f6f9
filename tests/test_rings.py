"""Polygons out of edge bags: parts, holes, touching, corners."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import boolean, layers, rings

BOX = "id string, minx double, miny double, maxx double, maxy double"
CASES = {
    # name: boxes, and for each part the corners of its rings
    "overlap": ([(0, 0, 3, 2), (1, 1, 12, 4)], [[8]]),
    "side": ([(0, 0, 2, 2), (2, 0, 4, 2)], [[4]]),
    "half a side": ([(0, 0, 2, 2), (2, 1, 4, 3)], [[8]]),
    "corner": ([(0, 0, 1, 1), (1, 1, 2, 2)], [[4], [4]]),
    "inside": ([(0, 0, 9, 9), (2, 2, 3, 3)], [[4]]),
    "hole": ([(0, 0, 3, 1), (0, 2, 3, 3), (0, 0, 1, 3), (2, 0, 3, 3)], [[4, 4]]),
    "hole that touches": ([(0, 0, 3, 1), (0, 1, 1, 3), (2, 1, 3, 2), (1, 2, 2, 3)], [[6, 4]]),
    "island in a hole": ([(0, 0, 9, 1), (0, 8, 9, 9), (0, 0, 1, 9), (8, 0, 9, 9), (3, 3, 6, 6)], [[4, 4], [4]]),
    "holes in a row": ([(0, 0, 41, 1), (0, 2, 41, 3), *[(2 * k, 0, 2 * k + 1, 3) for k in range(21)]], [[4] * 21]),
    "far apart": ([(0, 0, 1, 1), (100, 50, 101, 51)], [[4], [4]]),
}


def boxes(spark, cases=CASES):
    return G.from_boxes(spark.createDataFrame([(k, *map(float, b)) for k, (rows, _) in cases.items() for b in rows], BOX))


def shape(geometry):
    return sorted([len(r) - 1 for r in part] for part in geometry)


@pytest.mark.parametrize("cell", [None, 0.75])
def test_unions_of_boxes(spark, cell):
    edges = boolean.overlay(G.edges(boxes(spark), ["id"]).select("id", *G.EDGE), None, "union", ["id"], cell)
    got = {r.id: r.geometry for r in rings.polygons(edges, ["id"], cell).collect()}
    assert {k: shape(g) for k, g in got.items()} == {k: sorted(v[1]) for k, v in CASES.items()}


def test_dissolve_gives_whole_parts(spark):
    """What a dissolve returns can be split by its parts: a box that touches a polygon takes all of it."""
    t = boxes(spark, {k: CASES[k] for k in ("overlap", "side", "corner", "far apart")}).withColumn("row_id", F.monotonically_increasing_id())
    d = layers.dissolve(t.withColumnRenamed("id", "ID"), "ID", "row_id", ["row_id"])
    assert {r.ID: (len(r.geometry), r.t) for r in d.withColumn("t", G.geometry_type("geometry")).collect()} == {"overlap": (1, "Polygon"), "side": (1, "Polygon"), "corner": (2, "MultiPolygon"), "far apart": (2, "MultiPolygon")}
    own = d.withColumn("NAME", F.col("ID")).select("ID", "NAME", "geometry")
    cut = layers.split_countries(own, (layers.SplitRule("overlap", "new", ((-1, -1, 0.5, 0.5),), {"NAME": "New"}),))
    assert {r.ID: r.a for r in cut.withColumn("a", G.area("geometry")).collect()}["new"] == 37.0


def _winding(polygon, x, y):
    """How often a region's geometry covers a point: shells count, holes count against."""
    n = 0
    for part in polygon:
        for ring in part:
            p = [tuple(q) for q in ring]
            n += sum(((a[1] > y) != (b[1] > y)) and a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) > x for a, b in zip(p, p[1:], strict=False))
    return n % 2 == 1


def test_star_polygons(spark):
    """Unions of crossing stars: valid orientation, every hole in its own shell, the same points covered."""
    rng, rows, stars = random.Random(4), [], {}
    for k in range(4):
        stars[k] = []
        for _ in range(4):
            x, y, n, size = rng.uniform(-4, 4), rng.uniform(-4, 4), rng.randrange(5, 25), rng.uniform(2, 6)
            pts = [(x + (r := size * rng.uniform(0.2, 1)) * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
            stars[k].append([[pts + pts[:1]]])
            rows += [(k, *map(float, (*a, *b))) for a, b in zip(pts, pts[1:] + pts[:1], strict=True)]
    bag = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double")
    found = {r.k: r for r in rings.polygons(boolean.repair(bag, ["k"]), ["k"]).withColumn("a", G.area("geometry")).collect()}
    area = {r.k: r.a for r in boolean.repair(bag, ["k"]).groupBy("k").agg(G.bag_area().alias("a")).collect()}
    for k, own in stars.items():
        geometry = [[[tuple(p) for p in ring] for ring in part] for part in found[k].geometry]
        assert abs(found[k].a - area[k]) < 1e-6
        signed = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
        for part in geometry:
            assert signed(part[0]) > 0 and all(signed(h) < 0 for h in part[1:])
            for h in part[1:]:
                inner = [(a[0] + b[0]) / 2 for a, b in zip(h, h[1:], strict=False)][0], [(a[1] + b[1]) / 2 for a, b in zip(h, h[1:], strict=False)][0]
                assert _winding([[part[0]]], *inner)
            assert all(n == 1 for n in Counter(part[0][:-1]).values())
        for _ in range(300):
            x, y = rng.uniform(-9, 9), rng.uniform(-9, 9)
            assert _winding(geometry, x, y) == any(_winding(s, x, y) for s in own)


def test_gaps_as_polygons(spark):
    whole = boxes(spark, {"w": ([(0, 0, 10, 10)], None), "v": ([(20, 0, 21, 1)], None)})
    cover = boxes(spark, {"a": ([(-1, -1, 4, 11)], None), "b": ([(6, 2, 8, 4)], None), "c": ([(9, -1, 11, 11)], None), "d": ([(19, -1, 22, 2)], None)})
    got = {r.id: shape(r.geometry) for r in layers.gap_polygons(whole, cover, "id").collect()}
    assert got == {"w": [[4, 4]]}


def test_nothing(spark):
    assert rings.polygons(G.edges(boxes(spark).limit(0), ["id"]), ["id"]).count() == 0
