"""Each way in which a polygon can be invalid, and shapes that only look so."""

import random

from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import validity

box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
hole = lambda *b: box(*b)[::-1]
OUTER = box(0, 0, 10, 10)
E, C, R, S, RS, H, N, D = validity.REASONS
CASES = {
    "box": ([[OUTER]], None),
    "clockwise box": ([[OUTER[::-1]]], None),
    "repeated points": ([[[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 0)]]], None),
    "points on a side": ([[[(0, 0), (1, 0), (2, 0), (4, 0), (4, 4), (0, 0)]]], None),
    "hole": ([[OUTER, hole(2, 2, 3, 3)]], None),
    "hole that touches the shell": ([[OUTER, [(0, 5), (2, 4), (2, 6), (0, 5)]]], None),
    "holes that touch": ([[OUTER, hole(2, 2, 4, 4), hole(4, 4, 6, 6)]], None),
    "parts that touch in a point": ([[box(0, 0, 2, 2)], [box(2, 2, 4, 4)]], None),
    "island in a hole": ([[OUTER, hole(2, 2, 8, 8)], [box(4, 4, 5, 5)]], None),
    "empty": ([], E),
    "null": (None, E),
    "not a number": ([[[(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (0.0, 0.0)]]], C),
    "open": ([[[(0, 0), (2, 0), (2, 2), (0, 2)]]], R),
    "two points": ([[[(0, 0), (2, 0), (0, 0), (0, 0)]]], R),
    "crossing": ([[[(0, 0), (2, 2), (2, 0), (0, 3), (0, 0)]]], S),
    "bow tie of equal halves": ([[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]], S),
    "flat": ([[[(0, 0), (2, 0), (1, 0), (0, 0)]]], S),
    "spike outwards": ([[[(0, 0), (4, 0), (4, 2), (7, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]], S),
    "spike inwards": ([[[(0, 0), (4, 0), (4, 2), (1, 2), (4, 2), (4, 4), (0, 4), (0, 0)]]], S),
    "ring that touches itself": ([[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]], RS),
    "ring through its own point": ([[[(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]]], RS),
    "hole outside": ([[OUTER, hole(20, 2, 23, 3)]], H),
    "hole over the shell": ([[OUTER, hole(8, 2, 13, 3)]], S),
    "hole in a hole": ([[OUTER, hole(2, 2, 8, 8), hole(4, 4, 5, 5)]], H),
    "hole along the shell": ([[OUTER, hole(0, 2, 3, 3)]], S),
    "nested shells": ([[OUTER], [box(4, 4, 5, 5)]], N),
    "same part twice": ([[OUTER], [OUTER]], S),
    "overlapping parts": ([[OUTER], [box(5, 5, 15, 15)]], S),
    "parts that share a side": ([[box(0, 0, 2, 2)], [box(2, 0, 4, 2)]], S),
    "hole that touches twice": ([[OUTER, [(0, 5), (5, 3), (10, 5), (5, 7), (0, 5)]]], D),
    "circle of holes": ([[OUTER, hole(2, 2, 4, 4), hole(4, 4, 6, 6), [(4, 2), (6, 2), (6, 4), (5, 3), (4, 2)]]], D),
    "shells that cross at points": ([[[(0, 0), (2, 1), (4, 0), (4, 4), (2, 3), (0, 4), (0, 0)]], [[(2, 1), (6, 1), (6, 3), (2, 3), (2, 1)]]], S),
}


def layer(spark, cases):
    return spark.createDataFrame([(k, None if g is None else [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in g]) for k, (g, _) in cases.items()], f"id string, geometry {G.GEOMETRY}")


def test_reasons(spark):
    got = {r.id: (r.valid, r.reason) for r in validity.check(layer(spark, CASES), ["id"]).collect()}
    assert got == {k: (why is None, why) for k, (_, why) in CASES.items()}


def test_large_geometries_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(validity, "FEW", 0)
    got = {r.id: r.reason for r in validity.check(layer(spark, CASES), ["id"]).collect()}
    assert got == {k: why for k, (_, why) in CASES.items()}


def test_winding_numbers_only_where_they_decide(spark, monkeypatch):
    """Crossings, rings that touch themselves and rings that keep apart need none; neither do parts side by side."""

    def never(*a, **k):
        raise AssertionError("a winding number was asked for")

    own = {k: c for k, c in CASES.items() if c[1] in (S, RS, E, R) or k in ("box", "hole", "island in a hole", "nested shells", "hole outside", "hole in a hole", "parts that touch in a point")}
    monkeypatch.setattr(validity.boolean, "overlay", never)
    got = {r.id: r.reason for r in validity.check(layer(spark, {k: c for k, c in own.items() if k != "shells that cross at points"}), ["id"]).collect()}
    assert got == {k: why for k, (_, why) in own.items() if k != "shells that cross at points"}


def test_moved_and_turned(spark):
    """The same shapes elsewhere, larger and turned, so that edges cross many cells."""
    rng, cases = random.Random(2), {}
    for k, (g, why) in CASES.items():
        if why in (None, H, N) and g:
            dx, dy, s = rng.randrange(-100, 100), rng.randrange(-50, 50), rng.choice([1, 8, 1024])
            cases[k] = [[[(dx + s * (3 * x - 4 * y), dy + s * (4 * x + 3 * y)) for x, y in ring] for ring in part] for part in g], why
    got = {r.id: r.reason for r in validity.check(layer(spark, cases), ["id"]).collect()}
    assert got == {k: why for k, (_, why) in cases.items()}


def test_only_invalid_regions_are_repaired(spark):
    from cellshare.plans import build
    from cellshare.plans.grid import Grid

    t = layer(spark, {k: CASES[k] for k in ("box", "bow tie of equal halves", "overlapping parts", "island in a hole", "empty", "null")}).withColumnRenamed("id", "region_id")
    grid = Grid(0, 0, 16, 16, 1)
    total = {r.region_id: round(r.a, 9) for r in build.mask(t, grid, normalise=False).groupBy("region_id").agg(F.sum("frac").alias("a")).collect()}
    assert total == {"box": 100.0, "bow tie of equal halves": 2.0, "overlapping parts": 175.0, "island in a hole": 65.0}
    bad = build.split_valid(t, "region_id")
    assert [sorted(r.region_id for r in x.collect()) for x in bad] == [["box", "island in a hole"], ["bow tie of equal halves", "overlapping parts"]]
