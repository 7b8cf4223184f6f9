"""Fractional coverage of grid cells by regions, from edge bags.

In cell units (u to the east, v to the south) an edge covers, to its right, the strip of rows that it passes.  Cut at all
grid lines, each piece lies in one cell: it gives that cell the area to its right, and all cells further right
of its row its height.  Sums by (region, row, col) and a running sum along the row are the exact fractions; no
geometry library, no loop over cells, and a region's size doesn't matter: work is dealt by edge and by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.grid import Grid

TINY = 1e-12


def _lines(a: Column, b: Column, top: int) -> Column:
    """Integers strictly between or at a and b, within the grid."""
    lo, hi = F.ceil(F.greatest(F.least(a, b), F.lit(0.0))), F.floor(F.least(F.greatest(a, b), F.lit(float(top))))
    return F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def pieces(edges: DataFrame, grid: Grid, region: str = "region_id") -> DataFrame:
    """Edges in cell units, cut at the grid lines they cross: ``region, row, col, area, cover``."""
    u = lambda x: (F.col(x) - grid.min_lon) / grid.dx
    v = lambda y: (F.lit(grid.max_lat) - F.col(y)) / grid.dy
    e = edges.select(region, u("x0").alias("u0"), v("y0").alias("v0"), u("x1").alias("u1"), v("y1").alias("v1"))
    # level edges and those beside or right of the grid cover nothing
    e = e.filter((F.col("v0") != F.col("v1")) & (F.least("v0", "v1") < grid.height) & (F.greatest("v0", "v1") > 0) & (F.least("u0", "u1") < grid.width))
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    at_u = F.when(du != 0, F.transform(_lines(F.col("u0"), F.col("u1"), grid.width), lambda k: (k - F.col("u0")) / du)).otherwise(F.array().cast("array<double>"))
    at_v = F.transform(_lines(F.col("v0"), F.col("v1"), grid.height), lambda k: (k - F.col("v0")) / dv)
    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), at_u, at_v)))
    cut = e.withColumn("t", t).select(region, "u0", "v0", "u1", "v1", F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))).alias("s"))
    ends = lambda s, p, q: F.when(F.col(s) == 0, F.col(p)).when(F.col(s) == 1, F.col(q)).otherwise(F.col(p) + F.col(s) * (F.col(q) - F.col(p)))
    cut = cut.select(region, ends("s.a", "u0", "u1").alias("ua"), ends("s.a", "v0", "v1").alias("va"), ends("s.b", "u0", "u1").alias("ub"), ends("s.b", "v0", "v1").alias("vb"))
    mu, mv = (F.col("ua") + F.col("ub")) / 2, (F.col("va") + F.col("vb")) / 2
    inside = cut.select(region, mu.alias("mu"), F.floor(mv).cast("int").alias("row"), (F.col("vb") - F.col("va")).alias("h")).filter(f"row >= 0 and row < {grid.height} and mu < {grid.width} and h <> 0")
    # what lies left of the grid still covers the row from its first column
    col = F.when(F.col("mu") < 0, F.lit(0)).otherwise(F.floor("mu")).cast("int")
    return inside.select(region, "row", col.alias("col"), F.when(F.col("mu") < 0, F.col("h")).otherwise(F.col("h") * (col + 1 - F.col("mu"))).alias("area"), F.col("h").alias("cover"))


def coverage(edges: DataFrame, grid: Grid, region: str = "region_id") -> DataFrame:
    """``region, row, col, frac`` for every cell that a region covers in part or whole.

    One exchange by (region, row) serves the sums and the running window; interior runs between stored columns are
    filled from the running cover.
    """
    cells = pieces(edges, grid, region).groupBy(region, "row", "col").agg(F.sum("area").alias("area"), F.sum("cover").alias("cover"))
    row = Window.partitionBy(region, "row").orderBy("col")
    before = F.coalesce(F.sum("cover").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = cells.select(region, "row", "col", (F.col("area") + before).alias("frac"), (F.col("cover") + before).alias("after"), F.lead("col").over(row).alias("next"))
    # a counter-clockwise ring goes down (v grows) on its left side, so cover comes out positive
    inner = F.when((F.abs("after") > TINY) & (F.coalesce("next", F.lit(grid.width)) > F.col("col") + 1), F.sequence(F.col("col") + 1, F.coalesce("next", F.lit(grid.width)) - 1))
    filled = run.select(region, "row", F.explode(F.concat(F.array(F.struct("col", "frac")), F.coalesce(F.transform(inner, lambda c: F.struct(c.alias("col"), F.col("after").alias("frac"))), F.array().cast("array<struct<col:int,frac:double>>")))).alias("c"))
    return filled.select(region, "row", F.col("c.col").alias("col"), F.col("c.frac").alias("frac")).filter(F.col("frac") > TINY)


def touched(edges: DataFrame, grid: Grid, region: str = "region_id") -> DataFrame:
    """``region, row, col`` of every cell that a region meets, if only in a point of its border.

    ``edges`` is a whole bag, level edges too.  Each edge is followed row by row through the cells that its closed
    squares meet; cells inside, away from all edges, come from the coverage.
    """
    u = lambda x: (F.col(x) - grid.min_lon) / grid.dx
    v = lambda y: (F.lit(grid.max_lat) - F.col(y)) / grid.dy
    e = edges.select(region, u("x0").alias("u0"), v("y0").alias("v0"), u("x1").alias("u1"), v("y1").alias("v1"))
    lo, hi = F.least("v0", "v1"), F.greatest("v0", "v1")
    met = lambda a, b, n: F.sequence(F.greatest(F.ceil(a) - 1, F.lit(0)).cast("int"), F.least(F.floor(b), F.lit(n - 1)).cast("int"))
    within = lambda a, b, n: (F.ceil(a) - 1 <= n - 1) & (F.floor(b) >= 0)
    rows = e.filter(within(lo, hi, grid.height)).withColumn("row", F.explode(met(lo, hi, grid.height)))
    at = lambda h: F.when(h == F.col("v0"), F.col("u0")).when(h == F.col("v1"), F.col("u1")).otherwise(F.col("u0") + (F.col("u1") - F.col("u0")) * ((h - F.col("v0")) / (F.col("v1") - F.col("v0"))))
    level = F.col("v0") == F.col("v1")
    a = F.when(level, F.col("u0")).otherwise(at(F.greatest(lo, F.col("row").cast("double"))))
    b = F.when(level, F.col("u1")).otherwise(at(F.least(hi, F.col("row") + F.lit(1.0))))
    ends = rows.select(region, "row", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(within(F.col("a"), F.col("b"), grid.width))
    border = ends.select(region, "row", F.explode(met(F.col("a"), F.col("b"), grid.width)).alias("col"))
    return border.unionByName(coverage(edges, grid, region).select(region, "row", "col")).distinct()


def cut_edges(edges: DataFrame, axis: str, at: float, keys: list[str]) -> DataFrame:
    """Edges that cross a line parallel to an axis, as two."""
    other = "y" if axis == "x" else "x"
    a0, a1, b0, b1 = (F.col(c) for c in (f"{axis}0", f"{axis}1", f"{other}0", f"{other}1"))
    on = b0 + (b1 - b0) * ((F.lit(at) - a0) / (a1 - a0))
    make = lambda p, q, r, s: F.struct(p.alias(f"{axis}0"), q.alias(f"{other}0"), r.alias(f"{axis}1"), s.alias(f"{other}1"))
    both = F.array(make(a0, b0, F.lit(at), on), make(F.lit(at), on, a1, b1))
    e = F.when((a0 - at) * (a1 - at) < 0, both).otherwise(F.array(make(a0, b0, a1, b1)))
    return edges.select(*keys, F.explode(e).alias("e")).select(*keys, "e.x0", "e.y0", "e.x1", "e.y1")


def clip_edges(edges: DataFrame, axis: str, at: float, below: bool, keys: list[str]) -> DataFrame:
    """The edge bag of what lies on one side of a line; the other side's points move onto it, which closes the cut."""
    hold = F.least if below else F.greatest
    moved = {f"{axis}{k}": hold(F.col(f"{axis}{k}"), F.lit(at)) for k in (0, 1)}
    return cut_edges(edges, axis, at, keys).withColumns(moved).filter("x0 <> x1 or y0 <> y1")


def clip_box(edges: DataFrame, minx: float, miny: float, maxx: float, maxy: float, keys: list[str]) -> DataFrame:
    """The edge bag of what lies in a rectangle."""
    for axis, at, below in (("x", minx, False), ("x", maxx, True), ("y", miny, False), ("y", maxy, True)):
        edges = clip_edges(edges, axis, float(at), below, keys)
    return edges


def wrap_longitude(edges: DataFrame, split: float, keys: list[str]) -> DataFrame:
    """Cut at a meridian and move what lies left of it by a turn.

    Each half is clipped at the meridian.  Edges that lie on it whole, with nothing of their own, are level or cancel.
    """
    flat = cut_edges(edges, "x", split, keys)
    right = flat.withColumns({c: F.greatest(c, F.lit(split)) for c in ("x0", "x1")})
    left = flat.withColumns({c: F.least(c, F.lit(split)) + 360 for c in ("x0", "x1")})
    return right.unionByName(left).filter("x0 <> x1 or y0 <> y1")


def cell_totals(mask: DataFrame) -> DataFrame:
    """Sum over regions in each cell; one for a complete layer."""
    return mask.groupBy("row", "col").agg(F.sum("frac").alias("total"))


def normalise(mask: DataFrame) -> DataFrame:
    """Each fraction, in single precision as it's stored, over the cell's sum."""
    single = F.col("frac").cast("float").cast("double")
    total = F.sum(single).over(Window.partitionBy("row", "col"))
    return mask.withColumn("frac", F.when(total == 0, F.lit(float("nan"))).otherwise(single / total))


def densify(mask: DataFrame, grid: Grid, regions: DataFrame, normalised: bool, region: str = "region_id") -> DataFrame:
    """All cells of the given regions: a missing fraction is 0, or NaN in a normalised mask where no region covers the cell.

    Meant for export of chosen regions; the cells of a region come from one range, not from a join of all pairs.
    """
    per = F.sequence(F.lit(0), F.lit(grid.width - 1))
    rows = F.sequence(F.lit(0), F.lit(grid.height - 1))
    cells = regions.select(region).select(region, F.explode(rows).alias("row")).select(region, "row", F.explode(per).alias("col"))
    out = cells.join(mask.select(region, "row", "col", "frac"), [region, "row", "col"], "left")
    if normalised:
        covered = mask.select("row", "col").distinct().withColumn("any", F.lit(True))
        out = out.join(covered, ["row", "col"], "left")
        gap = F.when(F.col("any").isNull(), F.lit(float("nan"))).otherwise(0.0)
    else:
        gap = F.lit(0.0)
    return out.select(region, "row", "col", F.coalesce("frac", gap).cast("float").alias("frac"))


def regional_mean(mask: DataFrame, observations: DataFrame, value: str, region: str = "region_id") -> DataFrame:
    """Extension: the mean of gridded values by region, weighted by coverage (planar, no latitude weight)."""
    both = observations.join(mask, ["row", "col"])
    return both.groupBy(region).agg(F.sum("frac").alias("weight"), (F.sum(F.col(value) * F.col("frac")) / F.sum("frac")).alias("mean"))


def to_cells(points: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The cell of each point; points outside the grid go."""
    at = points.withColumns({"col": F.floor((F.col(lon) - grid.min_lon) / grid.dx).cast("int"), "row": F.floor((F.lit(grid.max_lat) - F.col(lat)) / grid.dy).cast("int")})
    return at.filter(f"col >= 0 and col < {grid.width} and row >= 0 and row < {grid.height}")


def summary(spark: SparkSession, mask: DataFrame, grid: Grid, region: str = "region_id") -> DataFrame:
    """Covered cells and area by region, in cells and in squared degrees."""
    return mask.groupBy(region).agg(F.count("*").alias("cells"), F.sum("frac").alias("covered"), (F.sum("frac") * (grid.dx * grid.dy)).alias("area"))
