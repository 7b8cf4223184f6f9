"""Set operations on edge bags: intersection, difference, union, repair.

The plane is dealt in strips of x, cut into cells of y, whose size follows the edges' mean length, so that a cell
holds a bounded number of edges whatever a region's size.  Edges are cut at the strips' borders.  What lies left of a
strip matters to it only through its winding number at each height of the border, and that changes only where an edge
crosses the border: a running sum over these crossings is carried in as border edges.

Within a strip, edges of one key are cut where they cross and at every height where one begins, ends or crosses, so
that within a slab they don't cross and their middle tells their order.  Running sums of direction along the slab are
the winding numbers of both operands on either side of an edge; an edge is kept where the operation's result
differs, with the interior on its left.  Border edges only start the sums and are never kept.  Candidates for a
crossing meet in the cells, not pair by pair of a key.

Operands are whole bags, level edges too, as these cross borders like any other.  A result has none; before it is an
operand itself, ``rings.with_levels`` closes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

SNAP = 9
_IN = {
    "intersection": lambda a, b: (a != 0) & (b != 0),
    "difference": lambda a, b: (a != 0) & (b == 0),
    "union": lambda a, b: (a != 0) | (b != 0),
    # where a bag of shells and holes counts less than nothing or more than once; a shell's left side goes down, which counts -1
    "below": lambda a, b: a > 0,
    "above": lambda a, b: a < -1,
}


#: Cells are so many mean edge lengths wide and high, within bounds.
PER_CELL = 16
LEAST, MOST = 1 / 256, 2.0**30
CROWD = 64


def cell_size(edges: DataFrame) -> float:
    """A power of two near ``PER_CELL`` times the edges' mean extent."""
    mean = edges.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).collect()[0][0]
    return 2.0 ** round(math.log2(min(MOST, max(LEAST, PER_CELL * (mean or 1.0)))))


def crowded_size(edges: DataFrame, keys: list[str]) -> float:
    """``cell_size``, less where edges of one key lie over each other: so that a cell holds about ``CROWD`` of them, but twice the mean length at least."""
    size = cell_size(edges)
    middle = lambda c: F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2 / size)
    held = edges.groupBy(*keys, middle("x").alias("bx"), middle("y").alias("by")).agg(F.count("*").cast("double").alias("n"))
    met = held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).collect()[0][0] or 0.0
    return size / 2.0 ** max(0, min(int(math.log2(PER_CELL)) - 1, math.ceil(math.log2(max(met, 1.0) / CROWD) / 2)))


def _bucketed(e: DataFrame, size: float) -> DataFrame:
    lo, hi = F.floor(F.col("ylo") / size).cast("long"), F.floor(F.col("yhi") / size).cast("long")
    return e.withColumn("bucket", F.explode(F.sequence(lo, hi)))


def _oriented(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges from low to high with their direction; level ones carry no winding."""
    up = F.col("y1") > F.col("y0")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return edges.filter("y0 <> y1").select(*keys, F.when(up, 1).otherwise(-1).alias("turn"), pick("x0", "x1").alias("xlo"), pick("y0", "y1").alias("ylo"), pick("x1", "x0").alias("xhi"), pick("y1", "y0").alias("yhi"))


def _stripped(edges: DataFrame, keys: list[str], side: int, size: float) -> tuple[DataFrame, DataFrame]:
    """The edges of each strip, cut at its borders, and the borders' edges.

    A strip has its left border but not its right one.  An edge that comes in over the left border lowers the winding
    above the crossing, one that goes out raises it, whichever way it slopes.
    """
    e = edges.select(*keys, *[F.round(F.col(c), SNAP).alias(c) for c in ("x0", "y0", "x1", "y1")])
    first, last = (F.floor(f("x0", "x1") / size).cast("long") for f in (F.least, F.greatest))
    at = F.col("strip") * size
    on = lambda x: F.when(x == F.col("x0"), F.col("y0")).when(x == F.col("x1"), F.col("y1")).otherwise(F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * ((x - F.col("x0")) / (F.col("x1") - F.col("x0"))), SNAP))
    dealt = e.withColumn("strip", F.explode(F.sequence(first, last))).withColumns({"left": at, "right": at + size})
    hold = lambda x: F.greatest(F.col("left"), F.least(F.col("right"), F.col(x)))
    local = dealt.withColumns({"u0": hold("x0"), "u1": hold("x1")})
    local = local.withColumns({"v0": on(F.col("u0")), "v1": on(F.col("u1"))}).withColumns({"v0": F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(F.col("v0")), "v1": F.when(F.col("x0") == F.col("x1"), F.col("y1")).otherwise(F.col("v1"))})
    local = _oriented(local.select(*keys, "strip", F.col("u0").alias("x0"), F.col("v0").alias("y0"), F.col("u1").alias("x1"), F.col("v1").alias("y1")), [*keys, "strip"])
    crossing = dealt.filter("(x0 < left) <> (x1 < left)").select(*keys, "strip", "left", on(F.col("left")).alias("y"), F.when(F.col("x0") < F.col("left"), -1).otherwise(1).alias("step"))
    steps = crossing.groupBy(*keys, "strip", "left", "y").agg(F.sum("step").alias("step")).filter("step <> 0")
    order = Window.partitionBy(*keys, "strip").orderBy("y")
    wound = steps.withColumns({"turn": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("y").over(order)}).filter("turn <> 0 and to is not null")
    border = wound.select(*keys, "strip", "turn", F.col("left").alias("xlo"), F.col("y").alias("ylo"), F.col("left").alias("xhi"), F.col("to").alias("yhi"))
    return local.withColumn("side", F.lit(side)), border.withColumn("side", F.lit(side))


def wound(a: DataFrame, b: DataFrame | None, how: str, keys: list[str], size: float) -> DataFrame:
    """``keys, strip, border, ya, yb, xa, xb, inside``: where the result begins and ends along each slab of each strip.

    ``inside``: whether it lies right of the edge.  Where it comes in over the strip's border, so does the border.
    """
    local, border = _stripped(a, keys, 0, size)
    if b is not None:
        other = _stripped(b, keys, 1, size)
        local, border = local.unionByName(other[0]), border.unionByName(other[1])
    own, names = [*keys, "strip"], ["xlo", "ylo", "xhi", "yhi"]
    local = local.groupBy(*own, "side", *names).agg(F.sum("turn").alias("turn")).filter("turn <> 0")
    every = local.withColumn("border", F.lit(False)).unionByName(border.withColumns({"border": F.lit(True), "turn": F.col("turn").cast("long")}))
    left, right = _bucketed(local, size), _bucketed(local, size)
    l, r = left.select(*own, "bucket", *[F.col(c).alias(f"{c}_a") for c in names]), right.select(*own, "bucket", *[F.col(c).alias(f"{c}_b") for c in names])
    near = l.join(r, [*own, "bucket"]).filter("ylo_a < yhi_b and ylo_b < yhi_a and least(xlo_a, xhi_a) <= greatest(xlo_b, xhi_b) and least(xlo_b, xhi_b) <= greatest(xlo_a, xhi_a)")
    ma, mb = F.expr("(xhi_a - xlo_a) / (yhi_a - ylo_a)"), F.expr("(xhi_b - xlo_b) / (yhi_b - ylo_b)")
    y = F.when(ma != mb, (F.col("xlo_b") - F.col("xlo_a") + ma * F.col("ylo_a") - mb * F.col("ylo_b")) / (ma - mb))
    crossings = near.select(*own, F.round(y, SNAP).alias("y"), "ylo_a", "yhi_a", "ylo_b", "yhi_b").filter("y > ylo_a and y < yhi_a and y > ylo_b and y < yhi_b").select(*own, "y")
    heights = every.select(*own, F.col("ylo").alias("y")).union(every.select(*own, F.col("yhi").alias("y"))).union(crossings).distinct()
    high = heights.withColumn("bucket", F.floor(F.col("y") / size).cast("long"))
    # heights inside each edge, met by cell; its own ends close the list
    kind = [*own, "side", "border", "turn", *names]
    inner = _bucketed(every, size).join(high, [*own, "bucket"]).filter("y > ylo and y < yhi").groupBy(*kind).agg(F.collect_set("y").alias("ys"))
    cut = every.join(inner, kind, "left")
    ys = F.array_sort(F.array_distinct(F.concat(F.array("ylo", "yhi"), F.coalesce("ys", F.array().cast("array<double>")))))
    cut = cut.withColumn("ys", ys).select(*kind, F.explode(F.arrays_zip(F.slice("ys", 1, F.size("ys") - 1).alias("a"), F.slice("ys", 2, F.size("ys") - 1).alias("b"))).alias("s"))
    x: object = lambda c: F.when(F.col(c) == F.col("ylo"), F.col("xlo")).when(F.col(c) == F.col("yhi"), F.col("xhi")).otherwise(F.col("xlo") + (F.col("xhi") - F.col("xlo")) * ((F.col(c) - F.col("ylo")) / (F.col("yhi") - F.col("ylo"))))
    cut = cut.select(*own, "side", "border", "turn", F.col("s.a").alias("ya"), F.col("s.b").alias("yb"), F.round(x("s.a"), SNAP).alias("xa"), F.round(x("s.b"), SNAP).alias("xb"))
    turn = lambda s: F.sum(F.when(F.col("side") == s, F.col("turn")).otherwise(0))
    slab = cut.groupBy(*own, "border", "ya", "yb", "xa", "xb").agg(turn(0).alias("ta"), turn(1).alias("tb"))
    order = Window.partitionBy(*own, "ya", "yb").orderBy(F.desc("border"), F.col("xa") + F.col("xb"), "xa")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    slab = slab.withColumns({"wa": F.sum("ta").over(upto), "wb": F.sum("tb").over(upto)})
    inside: Column = _IN[how](F.col("wa"), F.col("wb"))
    before: Column = _IN[how](F.col("wa") - F.col("ta"), F.col("wb") - F.col("tb"))
    return slab.filter(inside != before).select(*own, "border", "ya", "yb", "xa", "xb", inside.alias("inside"))


def overlay(a: DataFrame, b: DataFrame | None, how: str, keys: list[str], cell: float | None = None) -> DataFrame:
    """Edge bag of ``a`` how ``b`` for each key; without ``b``, the union (or repair) of ``a`` by non-zero winding."""
    size = cell or cell_size(a if b is None else a.select("x0", "y0", "x1", "y1").union(b.select("x0", "y0", "x1", "y1")))
    # a border that one strip would close and the next open isn't an edge of the result
    kept = wound(a, b, how, keys, size).filter("not border")
    # entering to the right: the interior is on the left of a downward edge
    pick = lambda p, q, name: F.when(F.col("inside"), F.col(p)).otherwise(F.col(q)).alias(name)
    return kept.select(*keys, pick("xb", "xa", "x0"), pick("yb", "ya", "y0"), pick("xa", "xb", "x1"), pick("ya", "yb", "y1"))


def repair(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary of the non-zero winding: self-crossings and overlapping parts count once."""
    return overlay(edges, None, "union", keys, crowded_size(edges, keys))


def pieces_of_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, how: str, a_id: str, b_id: str) -> DataFrame:
    """Edge bags for each pair of regions, both ids kept."""
    # written: the overlay reads its operands many times
    pairs = settle(pairs)
    left, right = (settle(pairs.join(e, i).select(a_id, b_id, "x0", "y0", "x1", "y1")) for e, i in ((a, a_id), (b, b_id)))
    return overlay(left, right, how, [a_id, b_id])
