"""Hand-computed micro-cases and properties of coverage."""

import random

import pytest
from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import boolean, coverage
from cellshare.plans.grid import Grid

SHAPE = f"region_id string, geometry {G.GEOMETRY}"
SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def rect(x0, y0, x1, y1):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def cover(spark, parts, grid=Grid(0, 0, 4, 4, 1)):
    t = spark.createDataFrame([("r", parts)], SHAPE)
    rows = coverage.coverage(G.edges(t, ["region_id"]), grid).collect()
    # keyed from the south-west
    return {(r.col, grid.height - 1 - r.row): round(r.frac, 9) for r in rows}


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        ([[rect(1, 1, 3, 3)]], {(x, y): 1 for x in (1, 2) for y in (1, 2)}),
        ([[rect(0.5, 0.5, 1.5, 1.5)]], {(x, y): 0.25 for x in (0, 1) for y in (0, 1)}),
        ([[ring([(0, 0), (2, 0), (2, 2)])]], {(0, 0): 0.5, (1, 0): 1, (1, 1): 0.5}),
        ([[rect(0, 0, 3, 3), rect(1, 1, 2, 2)[::-1]]], {(x, y): 1 for x in range(3) for y in range(3) if (x, y) != (1, 1)}),
        ([[rect(0, 0, 0.5, 1)], [rect(0.75, 0, 1, 1)]], {(0, 0): 0.75}),
        ([[rect(-2, 1, 2, 2)]], {(0, 1): 1, (1, 1): 1}),
        ([[rect(2, -3, 9, 1)]], {(2, 0): 1, (3, 0): 1}),
        ([[rect(5, 5, 6, 6)]], {}),
        ([], {}),
    ],
)
def test_micro_cases(spark, parts, expected):
    assert cover(spark, parts) == expected


def test_orientation_does_not_matter(spark):
    assert cover(spark, [[rect(0.5, 0.5, 2, 2)[::-1]]]) == cover(spark, [[rect(0.5, 0.5, 2, 2)]])


def test_random_polygons_keep_their_area(spark):
    rng, rows = random.Random(5), []
    import math

    for k in range(20):
        n = rng.randint(3, 12)
        pts = [(8 + rng.uniform(1, 6) * math.cos(2 * math.pi * i / n), 8 + rng.uniform(1, 6) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        rows.append((f"r{k}", [[ring(pts)]]))
    t = spark.createDataFrame(rows, SHAPE)
    grid = Grid(0, 0, 16, 16, 0.5)
    total = coverage.coverage(G.edges(t, ["region_id"]), grid).groupBy("region_id").agg((F.sum("frac") * 0.25).alias("a"), F.max("frac").alias("m"))
    both = total.join(t.select("region_id", G.area("geometry").alias("b")), "region_id").collect()
    assert len(both) == 20
    assert all(abs(r.a - r.b) < 1e-8 and r.m < 1 + 1e-9 for r in both)


def test_wrap_keeps_area_and_moves_the_left_part(spark):
    t = spark.createDataFrame([("w", [[rect(-2, 0, 1, 1)]])], SHAPE)
    e = coverage.wrap_longitude(G.edges(t, ["region_id"]), -0.25, ["region_id"])
    assert e.agg(G.bag_area().alias("a")).collect()[0].a == 3
    cells = coverage.coverage(e, Grid(-0.25, 0, 359.75, 1, 0.25)).select("col").collect()
    assert {r.col for r in cells} == set(range(5)) | set(range(1433, 1440))


def test_grid_keeps_the_bounds():
    g = Grid(0, 0, 10, 7, 3)
    assert (g.width, g.height, g.dy) == (3, 2, 3.5)
    assert g.dx == pytest.approx(10 / 3)
    for bad in (0, -1, 20):
        with pytest.raises(ValueError):
            Grid(0, 0, 10, 10, bad)


def test_normalise_and_dense(spark):
    m = spark.createDataFrame([("a", 0, 0, 0.25), ("b", 0, 0, 0.5)], "region_id string, row int, col int, frac double")
    n = {r.region_id: r.frac for r in coverage.normalise(m).collect()}
    assert n == {"a": 0.25 / 0.75, "b": 0.5 / 0.75}
    dense = coverage.densify(coverage.normalise(m), Grid(0, 0, 2, 1, 1), m.select("region_id").distinct(), normalised=True).collect()
    assert len(dense) == 4
    assert all((r.frac != r.frac) == (r.col == 1) for r in dense)


def test_set_operations(spark):
    a = G.edges(spark.createDataFrame([("k", [[rect(0, 0, 2, 2)]])], SHAPE), ["region_id"])
    b = G.edges(spark.createDataFrame([("k", [[ring([(1, 1), (3, 1), (3, 3)])]])], SHAPE), ["region_id"])
    area = lambda e: e.agg(F.coalesce(G.bag_area(), F.lit(0.0)).alias("a")).collect()[0].a
    assert area(boolean.overlay(a, b, "intersection", ["region_id"])) == 0.5
    assert area(boolean.overlay(a, b, "difference", ["region_id"])) == 3.5
    assert area(boolean.overlay(a, b, "union", ["region_id"])) == 5.5
    bow = G.edges(spark.createDataFrame([("k", [[rect(0, 0, 2, 1)], [rect(1, 0, 3, 1)]])], SHAPE), ["region_id"])
    assert area(boolean.repair(bow, ["region_id"])) == 3
