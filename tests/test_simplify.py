"""Simplification against the recursive rule, touched cells against sampling."""

import math
import random

from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import coverage, simplify
from cellshare.plans.grid import Grid


def rule(points, tolerance):
    keep = {0, len(points) - 1}

    def go(i, j):
        (ax, ay), (bx, by), best = points[i], points[j], (-1.0, None)
        for k in range(i + 1, j):
            px, py, dx, dy = points[k][0] - ax, points[k][1] - ay, bx - ax, by - ay
            n = dx * dx + dy * dy
            t = max(0.0, min(1.0, (px * dx + py * dy) / n)) if n > 0 else 0.0
            d = math.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
            if d > best[0]:
                best = d, k
        if best[0] > tolerance:
            keep.add(best[1])
            go(i, best[1])
            go(best[1], j)

    go(0, len(points) - 1)
    return [points[k] for k in sorted(keep)]


def star(rng, x, y, n, size):
    p = [(x + (r := size * rng.uniform(0.6, 1)) * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return p + p[:1]


def test_simplify(spark):
    rng, rows = random.Random(3), []
    for k in range(12):
        rows.append((k, [[star(rng, 0, 0, rng.randrange(3, 90), 10), star(rng, 0, 0, 30, 1.5)[::-1]], [star(rng, 40, 0, 12, 0.1)]]))
    rows += [(50, []), (51, None)]
    df = spark.createDataFrame(rows, f"id int, geometry {G.GEOMETRY}")
    for tolerance in (0.0, 0.5, 3.0):
        got = {r.id: r.geometry for r in simplify.simplify(df, ["id"], tolerance).collect()}
        for k, g in rows:
            if g is None:
                assert got[k] is None
                continue
            want = [[[p for p in q] for ring in part if len(q := rule(ring, tolerance)) >= 4] for part in g if len(rule(part[0], tolerance)) >= 4]
            assert [[[tuple(p) for p in ring] for ring in part] for part in got[k]] == want


def test_touched_cells(spark):
    """Every sampled point of a region lies in a touched cell, every touched cell is near the region; contact counts."""
    rng, grid = random.Random(6), Grid(0, 0, 20, 10, 0.5)
    shapes = {k: star(rng, rng.uniform(-1, 21), rng.uniform(-1, 11), rng.randrange(3, 20), rng.uniform(0.2, 6)) for k in range(8)}
    df = spark.createDataFrame([(k, [[p]]) for k, p in shapes.items()], f"region_id int, geometry {G.GEOMETRY}")
    got = {(r.region_id, r.row, r.col) for r in coverage.touched(G.edges(df, ["region_id"]), grid).collect()}
    cell = lambda x, y: (math.floor((10 - y) / 0.5), math.floor(x / 0.5))
    hit = set()
    for k, p in shapes.items():
        for a, b in zip(p, p[1:], strict=False):
            for i in range(2001):
                r, c = cell(a[0] + (b[0] - a[0]) * i / 2000, a[1] + (b[1] - a[1]) * i / 2000)
                if 0 <= r < 20 and 0 <= c < 40:
                    hit.add((k, r, c))
    inside = {(r.region_id, r.row, r.col) for r in coverage.coverage(G.edges(df, ["region_id"]), grid).collect()}
    assert hit | inside <= got and len(got - hit - inside) <= len(got) // 50
    one = spark.createDataFrame([("a", 2.0, 2.0, 3.0, 3.0)], "region_id string, minx double, miny double, maxx double, maxy double")
    near = {(r.row, r.col) for r in coverage.touched(G.edges(G.from_boxes(one), ["region_id"]), Grid(0, 0, 8, 8, 1)).collect()}
    assert near == {(r, c) for r in (4, 5, 6) for c in (1, 2, 3)}
    assert coverage.touched(G.edges(G.from_boxes(one.withColumn("minx", F.col("minx") + 90).withColumn("maxx", F.col("maxx") + 90)), ["region_id"]), Grid(0, 0, 8, 8, 1)).count() == 0
