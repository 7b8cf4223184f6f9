"""Spatial predicates and joins: boxes that regions touch, candidate pairs by bounding box, nearest regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..sources.scratch import settle


def _edge_meets_box(e: str, b: str) -> Column:
    """Closed test of an edge against a box: the parameters inside both slabs overlap."""
    c = lambda x: F.col(f"{e}{x}")
    lo, hi, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q, low, high in (("x0", "x1", "minx", "maxx"), ("y0", "y1", "miny", "maxy")):
        d = c(q) - c(p)
        s, t = (F.col(f"{b}{low}") - c(p)) / F.when(d != 0, d), (F.col(f"{b}{high}") - c(p)) / F.when(d != 0, d)
        outside = outside | ((d == 0) & ((c(p) < F.col(f"{b}{low}")) | (c(p) > F.col(f"{b}{high}"))))
        lo, hi = F.greatest(lo, F.least(s, t)), F.least(hi, F.greatest(s, t))
    return ~outside & (lo <= hi)


def touching(parts: DataFrame, boxes: DataFrame, keys: list[str], bucket: float = 8.0) -> DataFrame:
    """``keys`` and ``box_id``: parts (one geometry with an id each) that a box intersects; contact counts, nothing is cut.

    Edges and boxes meet in buckets of x; a box wholly inside a part has no edge in it and is found by counting
    edges to the right of its corner.  Which side travels is left to Spark, which knows the boxes' size.
    """
    e = G.edges(parts, keys).select(*keys, *G.EDGE)
    b = boxes.select("box_id", *[F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    b = b.select("box_id", F.least("minx", "maxx").alias("minx"), F.least("miny", "maxy").alias("miny"), F.greatest("minx", "maxx").alias("maxx"), F.greatest("miny", "maxy").alias("maxy"))
    dealt = lambda df, lo, hi: df.withColumn("bucket", F.explode(F.sequence(F.floor(lo / bucket).cast("long"), F.floor(hi / bucket).cast("long"))))
    near = dealt(e, F.least("x0", "x1"), F.greatest("x0", "x1")).join(dealt(b, F.col("minx"), F.col("maxx")), "bucket")
    met = near.filter(_edge_meets_box("", "")).select(*keys, "box_id")
    # a corner inside: edges strictly above and below it, to the right
    y = dealt(e, F.least("y0", "y1"), F.greatest("y0", "y1")).join(dealt(b, F.col("miny"), F.col("miny")), "bucket")
    over = y.filter("(y0 > miny) <> (y1 > miny) and x0 + (miny - y0) * (x1 - x0) / (y1 - y0) > minx")
    inside = over.groupBy(*keys, "box_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").select(*keys, "box_id")
    return met.union(inside).distinct()


def bounding_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, bucket: float = 8.0) -> DataFrame:
    """Pairs whose bounding boxes overlap, by buckets of x and y; ``a`` and ``b`` have a ``geometry``."""

    def dealt(df: DataFrame, i: str, s: str) -> DataFrame:
        own = df.select(F.col(i), G.bounds("geometry").alias(s))
        bx = F.explode(F.sequence(F.floor(F.col(f"{s}.minx") / bucket).cast("long"), F.floor(F.col(f"{s}.maxx") / bucket).cast("long")))
        by = F.explode(F.sequence(F.floor(F.col(f"{s}.miny") / bucket).cast("long"), F.floor(F.col(f"{s}.maxy") / bucket).cast("long")))
        return own.withColumn("bx", bx).withColumn("by", by)

    both = dealt(a, a_id, "s").join(dealt(b, b_id, "t"), ["bx", "by"])
    return both.filter("s.minx <= t.maxx and t.minx <= s.maxx and s.miny <= t.maxy and t.miny <= s.maxy").select(a_id, b_id).distinct()


#: A box is compared with so many before and behind it first.
BESIDE = 4


def meeting_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _id``: boxes ``_b`` that meet another of their key, in a point at least.

    Boxes are dealt to cells of one to two times their own size.  Within a cell, sorted by their left sides, most that meet
    another meet one that is next to them; only the rest is compared with all, box by box, so that pairs of boxes which lie
    over each other in great numbers aren't made.
    """
    edge = lambda c: F.col(f"_b.{c}")
    extent = F.greatest(edge("maxx") - edge("minx"), edge("maxy") - edge("miny"))
    # powers of two; boxes without extent, and tiny ones, have the least
    level = F.when(extent > 2.0**-20, F.ceil(F.log2(extent))).otherwise(-20).cast("int")
    own = settle(boxes.select(*keys, "_id", "_b", level.alias("level")))
    levels = sorted(r[0] for r in own.select("level").distinct().collect())
    if not levels:
        return own.select(*keys, "_id")
    size = F.pow(F.lit(2.0), F.col("at"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(edge(lo) / size).cast("long"), F.floor(edge(hi) / size).cast("long")))
    dealt = lambda df: df.withColumn("bx", cells("minx", "maxx")).withColumn("by", cells("miny", "maxy"))
    cell = [*keys, "at", "bx", "by"]
    meets = lambda o: (edge("minx") <= o["maxx"]) & (o["minx"] <= edge("maxx")) & (edge("miny") <= o["maxy"]) & (o["miny"] <= edge("maxy"))
    order = Window.partitionBy(*cell).orderBy("_b.minx", "_b.miny", "_id")
    alike = dealt(own.withColumn("at", F.col("level")))
    next_ = [f("_b", k).over(order) for f in (F.lag, F.lead) for k in range(1, BESIDE + 1)]
    beside = alike.select(*keys, "_id", F.array(*next_).alias("_next"), "_b").filter(F.exists("_next", lambda o: F.coalesce(meets(o), F.lit(False))))
    sure = settle(beside.select(*keys, "_id").distinct())
    rest = settle(own.join(sure, [*keys, "_id"], "left_anti"))
    if rest.isEmpty():
        return sure
    # of two boxes the smaller one is in every larger one's cells, too
    upward = lambda df: dealt(df.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("level")))))
    at_own = lambda df: dealt(df.withColumn("at", F.col("level")))
    as_other = lambda df: df.select(*cell, F.col("_id").alias("_other"), F.col("_b").alias("_c"))
    pairs = upward(rest).join(as_other(at_own(own)), cell).unionByName(at_own(rest).join(as_other(upward(own)), cell))
    late = pairs.filter((F.col("_id") != F.col("_other")) & meets(F.col("_c"))).select(*keys, "_id")
    return sure.unionByName(late).distinct()


def _segment_distance() -> Column:
    """Squared distance of the edges ``x0 ... y1`` and ``p0 ... q1``."""

    def to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        dx, dy = x1 - x0, y1 - y0
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.when(n > 0, n)))).otherwise(0.0)
        ex, ey = x0 + t * dx - px, y0 + t * dy - py
        return ex * ex + ey * ey

    a, b = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in ("p0", "q0", "p1", "q1")]
    side = lambda u, v, w: (u[2] - u[0]) * (w - u[1]) - (u[3] - u[1]) * (v - u[0])
    cross = (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)
    ends = F.least(to_segment(a[0], a[1], *b), to_segment(a[2], a[3], *b), to_segment(b[0], b[1], *a), to_segment(b[2], b[3], *a))
    return F.when(cross, 0.0).otherwise(ends)


def _candidates(sa: DataFrame, sb: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """``a_id, b_id``: for each box ``s`` of ``a`` the boxes ``t`` of ``b`` that can hold what is nearest.

    Boxes meet in square cells of the plane, each ``s`` widened by the cell's size.  If among what it meets some box lies
    whole within that distance, the rest of ``b`` is too far, and boxes that begin beyond the nearest end are, too.  What
    finds none goes on with cells four times the size, until one cell holds everything.
    """
    # ids and boxes alone; written, as are the rounds' results, or the plan would hold each round many times over
    sa, sb = settle(sa), settle(sb)
    ends = sa.select(F.col("s").alias("b")).union(sb.select(F.col("t").alias("b"))).agg(*[f(f"b.{c}") for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]).collect()[0]
    if ends[0] is None:
        return sa.sparkSession.createDataFrame([], StructType([sa.schema[a_id], sb.schema[b_id]]))
    extent = max(ends[2] - ends[0], ends[3] - ends[1], 1e-9)
    size, left, out = extent / 64, sa, None
    gap = lambda lo, hi: F.greatest(F.col(f"s.{lo}") - F.col(f"t.{hi}"), F.col(f"t.{lo}") - F.col(f"s.{hi}"), F.lit(0.0))
    far = lambda lo, hi: F.greatest(F.col(f"s.{hi}") - F.col(f"t.{lo}"), F.col(f"t.{hi}") - F.col(f"s.{lo}"))
    dx, dy, wx, wy = gap("minx", "maxx"), gap("miny", "maxy"), far("minx", "maxx"), far("miny", "maxy")
    while True:
        cells = lambda c, lo, hi, wide, size=size: F.explode(F.sequence(F.floor((F.col(f"{c}.{lo}") - wide) / size).cast("long"), F.floor((F.col(f"{c}.{hi}") + wide) / size).cast("long")))
        x = left.withColumn("bx", cells("s", "minx", "maxx", size)).withColumn("by", cells("s", "miny", "maxy", size))
        y = sb.withColumn("bx", cells("t", "minx", "maxx", 0.0)).withColumn("by", cells("t", "miny", "maxy", 0.0))
        met = x.join(y, ["bx", "by"]).select(a_id, b_id, (dx * dx + dy * dy).alias("least"), (wx * wx + wy * wy).alias("most")).distinct()
        met = met.withColumn("bound", F.min("most").over(Window.partitionBy(a_id)))
        last = size > 2 * extent
        done = settle(met.filter("least <= bound" if last else (F.col("least") <= F.col("bound")) & (F.col("bound") <= size * size)).select(a_id, b_id))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = settle(left.join(done.select(a_id).distinct(), a_id, "left_anti"))
        if left.isEmpty():
            return out
        size *= 4


def nearest(a: DataFrame, b: DataFrame, a_id: str, b_id: str, project: bool = True) -> DataFrame:
    """``a_id, b_id, distance``: for each region of ``a`` those of ``b`` at the least distance, ties all kept.

    Distances are planar, in Mercator metres if ``project``; 0 if regions touch, overlap or contain each other.  They tie if
    they are equal to the micrometre, or to nine digits of the layer's own unit, as sums of floats part what is equally near.
    Bounding boxes that meet in cells of the plane rule out most before edges are compared.
    """
    move = (lambda p: G.point(*G.mercator(p["x"], p["y"]))) if project else (lambda p: p)
    ga, gb = (df.select(F.col(i), G.map_points("geometry", move).alias("geometry")) for df, i in ((a, a_id), (b, b_id)))
    full = lambda df, i, c: df.select(i, G.bounds("geometry").alias(c)).filter(F.col(f"{c}.minx").isNotNull())
    pairs = _candidates(full(ga, a_id, "s"), full(gb, b_id, "t"), a_id, b_id)
    ea = G.edges(ga, [a_id]).select(a_id, *G.EDGE)
    eb = G.edges(gb, [b_id]).select(b_id, F.col("x0").alias("p0"), F.col("y0").alias("q0"), F.col("x1").alias("p1"), F.col("y1").alias("q1"))
    apart = pairs.join(ea, a_id).join(eb, b_id).groupBy(a_id, b_id).agg(F.min(_segment_distance()).alias("d2"))
    # one inside the other: an odd number of edges to the right of its first point
    first = ga.select(a_id, F.col("geometry")[0][0][0].alias("_p"))
    right = pairs.join(first, a_id).join(eb, b_id).filter("(q0 > _p.y) <> (q1 > _p.y) and p0 + (_p.y - q0) * (p1 - p0) / (q1 - q0) > _p.x")
    back = gb.select(b_id, F.col("geometry")[0][0][0].alias("_p"))
    left = pairs.join(back, b_id).join(ea, a_id).filter("(y0 > _p.y) <> (y1 > _p.y) and x0 + (_p.y - y0) * (x1 - x0) / (y1 - y0) > _p.x")
    odd = lambda df: df.groupBy(a_id, b_id).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(a_id, b_id)
    inside = odd(right).union(odd(left)).distinct().withColumn("in", F.lit(True))
    exact = apart.join(inside, [a_id, b_id], "left").withColumn("distance", F.when(F.col("in"), 0.0).otherwise(F.sqrt("d2")))
    order = F.round("distance", 6 if project else 9)
    return exact.withColumn("r", F.rank().over(Window.partitionBy(a_id).orderBy(order))).filter("r = 1").select(a_id, b_id, "distance")
