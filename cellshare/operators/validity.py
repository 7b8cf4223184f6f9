"""Validity of polygons, with the reason: rings, crossings, touching, nesting, connection.

Edges of one geometry meet in cells along their way.  Two that cross, or run along each other, make it invalid; two
of one ring that touch without being neighbours make the ring touch itself; rings of one part may touch in points as
long as the touches form no circle, for that would part the interior.  What remains is nesting, and winding numbers
tell it: with shells counter-clockwise and holes clockwise, a part's winding is negative where a hole leaves its shell or
lies in another hole, and a geometry's is above one where a shell lies in another part.

An empty geometry is invalid here, as a layer has no use for it, and so is a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import settle
from . import boolean

#: In the order in which they are named when several hold.
REASONS = ("Empty", "Invalid coordinate", "Ring not closed or too few points", "Self-intersection", "Ring self-intersection", "Hole outside shell or in another hole", "Nested shells", "Interior is disconnected")

#: Geometries with so many points at most are compared with themselves in their row.
FEW = 32


def along(edges: DataFrame, size: float) -> DataFrame:
    """``edges`` with ``bx, by``: the cells that an edge passes, row by row, its ends and contacts included."""
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumn("by", F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))))
    at = lambda y: F.col("x0") + (F.col("x1") - F.col("x0")) * ((F.greatest(lo, F.least(hi, y)) - F.col("y0")) / (F.col("y1") - F.col("y0")))
    level = F.col("y0") == F.col("y1")
    p, q = (F.when(level, F.col(c)).otherwise(at(b)) for c, b in (("x0", F.col("by") * size), ("x1", (F.col("by") + 1) * size)))
    near = F.lit(1e-9)
    return rows.withColumn("bx", F.explode(F.sequence(F.floor((F.least(p, q) - near) / size).cast("long"), F.floor((F.greatest(p, q) + near) / size).cast("long"))))


def _pairs_in_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the edges ``a`` and ``b`` of every pair of a geometry's edges, made where the geometry is."""
    of_ring = lambda ring, i, j: F.transform(F.slice(ring, 2, F.size(ring)), lambda q, k: F.struct(i.alias("part"), j.alias("ring"), (k + 1).alias("place"), (F.size(ring) - 1).alias("last"), F.get(ring, k)["x"].alias("x0"), F.get(ring, k)["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    every = F.flatten(F.transform("geometry", lambda part, i: F.flatten(F.transform(part, lambda ring, j: of_ring(ring, i, j)))))
    first = rows.select(*keys, every.alias("e")).select(*keys, "e", F.posexplode("e").alias("i", "a"))
    return first.select(*keys, "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))


def _pairs_in_cells(edges: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The same of pairs that have a cell in common."""
    own = along(edges, size)
    a, b = (own.select(*keys, "bx", "by", F.struct("part", "ring", "place", "last", *G.EDGE).alias(s)) for s in "ab")
    both = a.join(b, [*keys, "bx", "by"]).filter("a.part < b.part or (a.part = b.part and (a.ring < b.ring or (a.ring = b.ring and a.place < b.place)))")
    return both.select(*keys, "a", "b")


def _meetings(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part_a, ring_a, part_b, ring_b, crosses, x, y`` of the pairs of edges that have a point in common, neighbours of a ring only if they run along each other."""
    both = pairs.select(*keys, *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("part", "ring", "place", "last", *G.EDGE)])
    v = lambda c, k, s: F.col(f"{c}{k}_{s}")
    span = lambda c, s: (F.least(v(c, 0, s), v(c, 1, s)), F.greatest(v(c, 0, s), v(c, 1, s)))
    common = {c: F.least(span(c, "a")[1], span(c, "b")[1]) - F.greatest(span(c, "a")[0], span(c, "b")[0]) for c in "xy"}
    both = both.filter((common["x"] >= 0) & (common["y"] >= 0))
    side = lambda s, t, k: (v("x", 1, s) - v("x", 0, s)) * (v("y", k, t) - v("y", 0, s)) - (v("y", 1, s) - v("y", 0, s)) * (v("x", k, t) - v("x", 0, s))
    both = both.withColumns({"b0": side("a", "b", 0), "b1": side("a", "b", 1), "a0": side("b", "a", 0), "a1": side("b", "a", 1)})
    crosses = ((F.col("b0") * F.col("b1") < 0) & (F.col("a0") * F.col("a1") < 0)) | ((F.col("b0") == 0) & (F.col("b1") == 0) & (F.greatest(common["x"], common["y"]) > 0))
    within = lambda s, t, k: (F.col(f"{t}{k}") == 0) & v("x", k, t).between(*span("x", s)) & v("y", k, t).between(*span("y", s))
    touch = F.coalesce(*[F.when(within(s, t, k), F.struct(v("x", k, t).alias("x"), v("y", k, t).alias("y"))) for s, t, k in (("a", "b", 0), ("a", "b", 1), ("b", "a", 0), ("b", "a", 1))])
    same = (F.col("part_a") == F.col("part_b")) & (F.col("ring_a") == F.col("ring_b"))
    beside = same & ((F.col("place_b") - F.col("place_a") == 1) | ((F.col("place_a") == 1) & (F.col("place_b") == F.col("last_b"))))
    one = lambda crosses, p: F.array(F.struct(F.lit(crosses).alias("crosses"), p.alias("p")))
    # exploded, so that a filter on it doesn't work it out again
    found = F.explode(F.when(crosses, one(True, F.lit(None).cast("struct<x:double,y:double>"))).when(~beside, one(False, touch)))
    met = both.select(*keys, "part_a", "ring_a", "part_b", "ring_b", found.alias("m")).filter("m.crosses or m.p is not null")
    return met.select(*keys, "part_a", "ring_a", "part_b", "ring_b", "m.crosses", "m.p.x", "m.p.y")


def _circles(touches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of the parts whose rings and touching points form a circle: what is left when ends are taken off again and again."""
    by = [*keys, "part"]
    own = touches.select(*keys, F.col("part_a").alias("part"), F.explode(F.array("ring_a", "ring_b")).alias("ring"), "x", "y").distinct()
    left = settle(own)
    n = left.count()
    while n:
        for end in ("ring",), ("x", "y"):
            left = left.withColumn("n", F.count("*").over(Window.partitionBy(*by, *end))).filter("n > 1").drop("n")
        left = settle(left)
        n, before = left.count(), n
        if n == before:
            break
    return left.select(*keys).distinct()


def _nesting() -> Column:
    """5 or 6 if a ring lies where it mustn't, in a ``geometry`` no two rings of which meet: one point tells where a ring lies."""

    def inside(p: Column, ring: Column) -> Column:
        over = lambda a, b: F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) > p["x"]).otherwise(False)
        n = F.size(ring) - 1
        return F.size(F.filter(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), over), lambda v: v)) % 2 == 1

    some = lambda places: F.exists(places, lambda v: v)
    in_other = lambda part, h, j: some(F.transform(part, lambda o, k: (k > 0) & (k != j) & inside(h[0], o)))
    hole = F.exists("geometry", lambda part: some(F.transform(part, lambda h, j: (j > 0) & (~inside(h[0], part[0]) | in_other(part, h, j)))))
    within = lambda p, part: F.size(F.filter(part, lambda ring: inside(p, ring))) % 2 == 1
    shell = some(F.transform("geometry", lambda part, i: some(F.transform("geometry", lambda q, j: (i != j) & (F.size(part) > 0) & within(F.get(F.get(part, F.lit(0)), F.lit(0)), q)))))
    holed, several = F.exists("geometry", lambda part: F.size(part) > 1), F.size("geometry") > 1
    return F.when(holed & hole, 5).when(several & shell, 6)


def _boxes_overlap() -> Column:
    """Whether the boxes of two parts of ``geometry`` have more than a border in common."""
    boxes = F.transform("geometry", lambda part: G.bounds(F.array(part)))
    over = lambda a, b: (a["minx"] < b["maxx"]) & (b["minx"] < a["maxx"]) & (a["miny"] < b["maxy"]) & (b["miny"] < a["maxy"])
    pairs = F.transform(boxes, lambda a, i: F.exists(F.slice(boxes, i + 2, F.size("geometry")), lambda b: over(a, b)))
    return F.exists(pairs, lambda v: v)


def check(table: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """``keys, valid, reason`` for each row (``keys`` tell rows apart); the first of ``REASONS`` that holds, null if none does.

    Edges of geometries with few points are compared where they are, the others' meet in cells.  Winding numbers are taken only
    where they decide: not where edges cross or a ring touches itself, which is the reason then, nor where few rings keep apart.
    A part of one ring, simple by then, winds once around what is in it.
    """
    # dealt out: a small file of rows may be much work
    own = table.select(*keys, F.col(geometry).alias("geometry")).repartition(*keys)
    points = F.flatten(F.flatten("geometry"))
    finite = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    closed = F.forall(F.flatten("geometry"), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (F.size(F.array_distinct(r)) >= 3))
    shape = F.when(F.col("geometry").isNull() | (F.size("geometry") == 0), 0).when(~finite, 1).when(~closed, 2)
    moves = lambda ring: F.filter(ring, lambda p, i: (i == 0) | (p["x"] != F.get(ring, i - 1)["x"]) | (p["y"] != F.get(ring, i - 1)["y"]))
    single = F.transform("geometry", lambda part: F.transform(part, moves))
    rows = settle(own.select(*keys, single.alias("geometry"), shape.alias("fault"), (F.size(points) <= FEW).alias("few")))
    sound = rows.filter("fault is null")
    pairs = _pairs_in_rows(sound.filter("few"), keys)
    many = sound.filter("not few")
    if not many.isEmpty():
        edges = settle(G.edges(many, keys, counted=True).withColumn("place", F.col("seq") + 1))
        pairs = pairs.unionByName(_pairs_in_cells(edges, keys, boolean.cell_size(edges)))
    met = settle(_meetings(pairs, keys))
    touch = 9
    worst = met.groupBy(*keys).agg(F.min(F.when(F.col("crosses"), 3).when(F.expr("part_a = part_b and ring_a = ring_b"), 4).otherwise(touch)).alias("worst"))
    apart = F.col("worst").isNull() & F.col("few")
    known = rows.join(worst, keys, "left").withColumn("known", F.when(F.col("fault").isNull() & apart, _nesting()))
    fault = F.coalesce("fault", F.when(F.col("worst") < touch, F.col("worst")), "known")
    open_ = F.col("fault").isNull() & ~apart & (F.coalesce("worst", F.lit(touch)) == touch)
    holed, several = F.exists("geometry", lambda part: F.size(part) > 1), F.when(F.col("few"), _boxes_overlap()).otherwise(F.size("geometry") > 1)
    flags = known.select(*keys, "geometry", fault.alias("fault"), (open_ & holed).alias("holed"), (open_ & several).alias("several"))
    state = settle(flags.withColumn("geometry", F.when(F.col("holed") | F.col("several"), F.col("geometry"))))
    left = state.filter("geometry is not null")
    code = F.col("fault")
    if not left.isEmpty():
        edges = settle(G.edges(left, [*keys, "holed", "several"]))
        size = boolean.cell_size(edges)
        every = boolean.overlay(edges.filter("holed"), None, "below", [*keys, "part"], size).select(*keys, F.lit(5).alias("fault"))
        every = every.unionByName(boolean.overlay(edges.filter("several"), None, "above", keys, size).select(*keys, F.lit(6).alias("fault")))
        every = every.unionByName(_circles(met.filter("not crosses and part_a = part_b and ring_a <> ring_b"), keys).select(*keys, F.lit(7).alias("fault")))
        state, code = state.join(every.groupBy(*keys).agg(F.min("fault").alias("found")), keys, "left"), F.coalesce("fault", "found")
    return state.select(*keys, code.isNull().alias("valid"), F.when(code.isNotNull(), F.element_at(F.array(*map(F.lit, REASONS)), code + 1)).alias("reason"))
