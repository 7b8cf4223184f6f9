"""Fewer points within a tolerance, ring by ring (Douglas and Peucker's rule), all rings at once.

A stretch between two kept points is done if none of its points lies further from the line between them than the
tolerance; otherwise the furthest is kept, the first if several are, and both halves go on.  A round treats every
stretch of every ring, and points of stretches that are done go, so rounds are as many as the deepest ring needs and
shrink quickly.

Rings of which fewer than four points stay go, and parts whose shell goes; a geometry may end empty.  As each ring
is on its own, neighbours may part by up to the tolerance and thin shapes may cross themselves: ``validity`` tells and
``boolean.repair`` mends that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import settle


def simplify(table: DataFrame, keys: list[str], tolerance: float, geometry: str = "geometry") -> DataFrame:
    """``keys, geometry`` for each row; ``keys`` tell rows apart.  Null geometries stay null."""
    names, own = keys, [f"_key{k}" for k in range(len(keys))]
    rows = settle(table.select(*[F.col(a).alias(b) for a, b in zip(names, own, strict=True)], F.col(geometry).alias("geometry")))
    rings = rows.select(*own, F.posexplode("geometry").alias("part", "rings")).select(*own, "part", F.posexplode("rings").alias("ring", "pts"))
    of = [*own, "part", "ring"]
    left = rings.select(*of, F.size("pts").alias("n"), F.posexplode("pts").alias("seq", "p"))
    left = left.select(*of, "seq", "p", ((F.col("seq") == 0) | (F.col("seq") == F.col("n") - 1)).alias("kept"))
    order = Window.partitionBy(*of).orderBy("seq")
    mine = F.when(F.col("kept"), F.col("p"))
    while True:
        near = left.withColumns({
            "stretch": F.sum(F.col("kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "a": F.last(mine, True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "b": F.first(mine, True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        })
        dx, dy, px, py = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("p.x") - F.col("a.x"), F.col("p.y") - F.col("a.y")
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.when(long > 0, long)))).otherwise(0.0)
        off = F.when(F.col("kept"), -1.0).otherwise(F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)))
        far = near.withColumn("off", off).withColumn("top", F.max(F.struct("off", -F.col("seq"))).over(Window.partitionBy(*of, "stretch")))
        chosen = (F.col("top.off") == F.col("off")) & (F.col("top.col2") == -F.col("seq"))
        left = settle(far.filter(F.col("kept") | (F.col("top.off") > tolerance)).select(*of, "seq", "p", (F.col("kept") | chosen).alias("kept")))
        if left.filter("not kept").isEmpty():
            break
    points = left.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"]).alias("pts")).filter(F.size("pts") >= 4)
    parts = points.groupBy(*own, "part").agg(F.min("ring").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ring", "pts"))), lambda s: s["pts"]).alias("rings")).filter("first = 0")
    shape = parts.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rings"))), lambda s: s["rings"]).alias("_shape"))
    joined = rows.select(*own, F.col("geometry").isNull().alias("_none")).join(shape, own, "left")
    return joined.select(*[F.col(b).alias(a) for a, b in zip(names, own, strict=True)], F.when(~F.col("_none"), F.coalesce("_shape", F.array().cast(G.GEOMETRY))).alias("geometry"))
