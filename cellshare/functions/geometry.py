"""Planar geometry as arrays and as edge bags.

A geometry is ``array<array<array<struct<x, y>>>>``: parts, rings (the first outer and counter-clockwise, the rest
holes and clockwise), points of a closed ring.  An edge bag is a table of directed edges ``x0, y0, x1, y1``
with the interior on the left; area, bounds, coverage and set operations read edge bags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
RADIUS = 6378137.0
EDGE = ["x0", "y0", "x1", "y1"]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    """A rectangle's ring, counter-clockwise; reversed bounds are accepted."""
    x0, x1, y0, y1 = F.least(minx, maxx), F.greatest(minx, maxx), F.least(miny, maxy), F.greatest(miny, maxy)
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))))


def bounds_struct(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    return F.struct(F.least(minx, maxx).alias("minx"), F.least(miny, maxy).alias("miny"), F.greatest(minx, maxx).alias("maxx"), F.greatest(miny, maxy).alias("maxy"))


def map_points(geometry: Column | str, f) -> Column:
    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, f)))


def translate(geometry: Column | str, dx: float, dy: float = 0.0) -> Column:
    return map_points(geometry, lambda p: point(p["x"] + dx, p["y"] + dy))


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres; latitudes are held strictly inside the poles."""
    lat = F.greatest(F.lit(-89.999999), F.least(F.lit(89.999999), y))
    return F.radians(x) * RADIUS, F.asinh(F.tan(F.radians(lat))) * RADIUS


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.sinh(y / RADIUS)))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula, positive if counter-clockwise."""
    n = F.size(ring)
    ahead, behind = F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, F.greatest(n - 1, F.lit(0)))
    cross = F.zip_with(behind, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def area(geometry: Column | str) -> Column:
    """Planar area in squared units; holes count against it."""
    return F.aggregate(F.transform(F.flatten(geometry), ring_area), F.lit(0.0), lambda acc, v: acc + v)


def bounds(geometry: Column | str) -> Column:
    points = F.flatten(F.flatten(geometry))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def is_empty(geometry: Column | str) -> Column:
    return F.size(geometry) == 0


def boundary(geometry: Column | str) -> Column:
    """The rings as lines, shells and holes alike: ``array<array<struct<x, y>>>``."""
    return F.flatten(geometry)


def line_length(line: Column) -> Column:
    """Planar length of a line of points."""
    n = F.size(line)
    ahead, behind = F.slice(line, 2, F.greatest(n - 1, F.lit(0))), F.slice(line, 1, F.greatest(n - 1, F.lit(0)))
    step = F.zip_with(behind, ahead, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))
    return F.aggregate(step, F.lit(0.0), lambda acc, v: acc + v)


def geometry_type(geometry: Column | str) -> Column:
    return F.when(F.size(geometry) > 1, "MultiPolygon").otherwise("Polygon")


def ring_is_valid(ring: Column) -> Column:
    """Closed, three distinct points at least, an area other than zero."""
    return (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & (F.size(F.array_distinct(ring)) >= 3) & (ring_area(ring) != 0)


def is_valid(geometry: Column | str) -> Column:
    return F.forall(F.flatten(geometry), ring_is_valid) & (F.size(geometry) > 0)


def clip_half(ring: Column, axis: str, limit: Column, keep_less: bool) -> Column:
    """A ring's part on one side of an axis-parallel line, closed along the line.

    Points on the other side move to the line; where an edge crosses it, the crossing is added.  The result may
    run back and forth on the line, which changes neither area nor coverage.
    """
    other = "y" if axis == "x" else "x"
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, 1, n - 1).alias("p"), F.slice(ring, 2, n - 1).alias("q"))
    hold = (lambda v: F.least(v, limit)) if keep_less else (lambda v: F.greatest(v, limit))
    make = lambda a, o: point(a, o) if axis == "x" else point(o, a)

    def along(e: Column) -> Column:
        p, q = e["p"], e["q"]
        crosses = (p[axis] - limit) * (q[axis] - limit) < 0
        at = p[other] + (q[other] - p[other]) * ((limit - p[axis]) / (q[axis] - p[axis]))
        return F.when(crosses, F.array(make(hold(p[axis]), p[other]), make(limit + 0.0, at))).otherwise(F.array(make(hold(p[axis]), p[other])))

    moved = F.flatten(F.transform(pairs, along))
    return F.concat(moved, F.slice(moved, 1, 1))


def parts(table: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row for each part, with its place."""
    keep = [c for c in table.columns if c != geometry]
    return table.select(*keep, F.posexplode(geometry).alias("part", "rings")).select(*keep, "part", F.array("rings").alias(geometry))


def edges(table: DataFrame, keys: list[str], geometry: str = "geometry", counted: bool = False) -> DataFrame:
    """The edge bag of a table of geometries; rings are turned so that the interior is on the left.  ``counted``: with ``last``, the ring's number of edges."""
    rings = table.select(*keys, F.posexplode(geometry).alias("part", "rings")).select(*keys, "part", F.posexplode("rings").alias("ring", "pts"))
    turned = F.when((F.col("ring") == 0) == (ring_area(F.col("pts")) >= 0), F.col("pts")).otherwise(F.reverse("pts"))
    n = F.size("pts")
    last = [(n - 1).alias("last")] if counted else []
    pairs = F.arrays_zip(F.slice("pts", 1, n - 1).alias("p"), F.slice("pts", 2, n - 1).alias("q"))
    flat = rings.withColumn("pts", turned).filter(n > 1).select(*keys, "part", "ring", *last, F.posexplode(pairs).alias("seq", "e"))
    return flat.select(*keys, "part", "ring", "seq", *(["last"] if counted else []), F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))


def bag_area() -> Column:
    """Aggregate over an edge bag; level edges may be missing."""
    return F.sum((F.col("x0") + F.col("x1")) / 2 * (F.col("y1") - F.col("y0")))


def from_boxes(table: DataFrame) -> DataFrame:
    """A layer with ``geometry`` from ``minx, miny, maxx, maxy``."""
    return table.withColumn("geometry", box("minx", "miny", "maxx", "maxy"))
