"""Polygons from edge bags: closed rings, holes in their shells, parts in their regions.

An edge bag from ``boolean`` has the interior on the left of each edge, no level edges, and more points than its
corners, as edges were cut.  Level edges follow from what the others leave open: along a height, the surplus of edges
that arrive over those that leave, summed from the left, is the boundary that runs there.

At each point, edges that arrive and edges that leave are ordered by angle, and each arriving edge is continued by
the next leaving one clockwise, so that a ring keeps to its own interior: polygons that touch in a point stay apart.
Following these links by pointer doubling, two steps a round, gives each edge its ring (its smallest edge) and its
place, in as many rounds as the logarithm of the longest ring.  A ring that comes to a point twice has a hole that
touches it; there, and only there, edges are linked anew the other way round, which parts the two.

Then points on a straight line go, and so do rings without area.  A clockwise ring is a hole.  Left of its leftmost
edge lies the polygon's interior, so the next edge to the left belongs to its shell or to a hole of the same polygon,
which leads on to the shell.

Work is dealt by point, by edge and by ring; a region with many rings is never in one task before its parts are
collected into the one geometry that the layer's model asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import settle
from . import boolean

#: Points this near are one, and a point this near to the line between its neighbours is on it: cuts are rounded to ``boolean.SNAP`` digits.
NEAR = 4 * 10.0**-boolean.SNAP


def with_levels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The bag with the level edges that close it."""
    end = lambda k, n: edges.select(*keys, F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.lit(n).alias("n"))
    open_ = end(1, 1).unionByName(end(0, -1)).groupBy(*keys, "y", "x").agg(F.sum("n").alias("n")).filter("n <> 0")
    order = Window.partitionBy(*keys, "y").orderBy("x")
    flow = open_.withColumns({"flow": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("x").over(order)}).filter("flow <> 0 and to is not null")
    flow = flow.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("flow"))))
    pick = lambda p, q, name: F.when(F.col("flow") > 0, F.col(p)).otherwise(F.col(q)).alias(name)
    return edges.select(*keys, *G.EDGE).unionByName(flow.select(*keys, pick("x", "to", "x0"), F.col("y").alias("y0"), pick("to", "x", "x1"), F.col("y").alias("y1")))


def _linked(edges: DataFrame, within: list[str], clockwise: bool) -> DataFrame:
    """``id, next``: at each point an arriving edge goes on with a leaving one, as brackets are matched around the point.

    Matching brackets gives each its own partner, whatever the order; where both kinds alternate it is the neighbour.
    """
    turn = lambda x, y: F.atan2(y, x) * (-1 if clockwise else 1)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    leave = edges.select(*within, F.col("x0").alias("x"), F.col("y0").alias("y"), turn(dx, dy).alias("angle"), "id", F.lit(0).alias("arrives"))
    arrive = edges.select(*within, F.col("x1").alias("x"), F.col("y1").alias("y"), turn(-dx, -dy).alias("angle"), "id", F.lit(1).alias("arrives"))
    at = [*within, "x", "y"]
    order = Window.partitionBy(*at).orderBy("angle", "arrives", "id")
    both = leave.unionByName(arrive).withColumn("depth", F.sum(F.col("arrives") * 2 - 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1 - F.col("arrives"))
    level = Window.partitionBy(*at, "depth").orderBy("angle", "arrives", "id")
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return both.withColumn("next", F.coalesce(F.lead("id").over(level), F.first("id").over(whole))).filter("arrives = 1").select("id", "next")


def _followed(links: DataFrame) -> DataFrame:
    """``id, ring, ahead``: the smallest id of each edge's ring and how many steps ahead it is."""
    state, span = links.select("id", "next", F.col("id").alias("ring"), F.lit(0).cast("long").alias("ahead")), 1
    while True:
        state = state.withColumn("news", F.lit(False))
        for _ in range(2):
            far = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"), (F.col("ahead") + span).alias("_ahead"))
            better = F.col("_ring") < F.col("ring")
            moved = lambda old, new: F.when(better, F.col(new)).otherwise(F.col(old)).alias(old)  # noqa: B023, E731
            state = state.join(far, "next").select("id", F.col("_next").alias("next"), moved("ring", "_ring"), moved("ahead", "_ahead"), (F.col("news") | better).alias("news"))
            span *= 2
        state = settle(state)
        if state.filter("news").isEmpty():
            return state.select("id", "ring", "ahead")


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ring, seq, x0 ... y1``: the edges of the closed bag, each in its ring and in order.

    No ring comes to a point twice.
    """
    own = settle(with_levels(edges, keys).withColumn("id", F.monotonically_increasing_id()))
    done = settle(own.join(_followed(_linked(own, keys, True)), "id"))
    twice = settle(done.groupBy("ring", "x0", "y0").count().filter("count > 1").select("ring").distinct())
    if not twice.isEmpty():
        again = done.join(twice, "ring", "left_semi").select(*keys, F.col("ring").alias("outer"), *G.EDGE, "id")
        parted = again.join(_followed(_linked(again, ["outer"], False)), "id")
        done = settle(done.join(twice, "ring", "left_anti").unionByName(parted.drop("outer")))
    # the smallest edge first, then the one furthest from it
    return done.select(*keys, "ring", F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead")).alias("seq"), *G.EDGE)


def _corners(ring_edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ring, points``: closed rings of corners alone."""
    by = [*keys, "ring"]
    order = Window.partitionBy(*by).orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = lambda step, end: F.coalesce(step("p").over(order), end("p").over(whole))
    p = ring_edges.select(*by, "seq", F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("p"))
    p = p.withColumn("a", beside(F.lag, F.last)).filter(F.greatest(F.abs(F.col("p.x") - F.col("a.x")), F.abs(F.col("p.y") - F.col("a.y"))) > NEAR)
    p = p.select(*by, "seq", "p").withColumns({"a": beside(F.lag, F.last), "b": beside(F.lead, F.first)})
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    off = F.abs((F.col("p.x") - F.col("a.x")) * dy - (F.col("p.y") - F.col("a.y")) * dx)
    p = p.filter(off > NEAR * F.greatest(F.abs(dx), F.abs(dy)))
    listed = p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"]).alias("points")).filter(F.size("points") >= 3)
    return listed.withColumn("points", F.concat("points", F.slice("points", 1, 1)))


def _shells(ring_edges: DataFrame, kinds: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``ring, shell`` of every hole (``kinds``: the rings, with ``is_hole``)."""
    holes = kinds.filter("is_hole").select("ring")
    slanted = ring_edges.filter("y0 <> y1")
    first = slanted.join(holes, "ring", "left_semi").groupBy(*keys, "ring").agg(F.min_by(F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), F.struct(F.col("x0") + F.col("x1"), F.col("y0") + F.col("y1"))).alias("p"))
    first = first.select(*keys, F.col("ring").alias("hole"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.floor(F.col("p.y") / size).cast("long").alias("bucket"))
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    dealt = slanted.select(*keys, "ring", *G.EDGE, F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))).alias("bucket"))
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * ((F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    left = first.join(dealt, [*keys, "bucket"]).filter((lo <= F.col("py")) & (F.col("py") < hi) & (F.col("ring") != F.col("hole")) & (x < F.col("px")))
    up = settle(left.groupBy("hole").agg(F.max_by("ring", x).alias("up")))
    while True:
        # a neighbour that is a hole itself leads on to its own; the chain shortens by half each time
        beyond = up.select(F.col("hole").alias("up"), F.col("up").alias("further"))
        up = settle(up.join(beyond, "up", "left").select("hole", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select(F.col("hole").alias("ring"), F.col("up").alias("shell"))
        up = up.drop("moved")


def polygons(edges: DataFrame, keys: list[str], cell: float | None = None) -> DataFrame:
    """``keys, geometry`` from an edge bag with the interior on the left: parts that meet in points at most, holes in their shells.

    Keys without an area have no row.  Parts are in order of their bounds.
    """
    names, keys = keys, [f"_key{k}" for k in range(len(keys))]
    own = rings(settle(edges.select(*[F.col(a).alias(b) for a, b in zip(names, keys, strict=True)], *G.EDGE)), keys)
    size = cell or boolean.cell_size(own)
    area = own.groupBy(*keys, "ring").agg(G.bag_area().alias("area"))
    shaped = settle(_corners(own, keys).join(area, [*keys, "ring"]).filter("area <> 0").withColumn("is_hole", F.col("area") < 0))
    shells = shaped.filter("not is_hole").select(*keys, F.col("ring").alias("shell"), "points")
    if not shaped.filter("is_hole").isEmpty():
        inner = shaped.filter("is_hole").join(_shells(own, shaped, keys, size), "ring").groupBy("shell").agg(F.array_sort(F.collect_list("points")).alias("holes"))
        shells = shells.join(inner, "shell", "left")
    else:
        shells = shells.withColumn("holes", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    part = F.concat(F.array("points"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")))
    least = F.array_min("points")
    each = F.struct(least["x"].alias("x"), least["y"].alias("y"), part.alias("part"))
    return shells.select(*[F.col(b).alias(a) for a, b in zip(names, keys, strict=True)], each.alias("s")).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]).alias("geometry"))
