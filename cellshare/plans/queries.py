"""One query for each operator of the inventory, on stand-in layers, with the same question in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import boolean, coverage, harmonise, layers, predicates, simplify, validity
from ..sources import arrays, scratch, shapefile, tables
from . import build
from .fixtures import load, sql
from .grid import Grid, sizes

GRID = Grid(0, 0, 32, 16, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = sql(oracle)
        return f

    return register


def layer(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return G.from_boxes(load(spark, sf, name))


def mask_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return coverage.coverage(G.edges(layer(spark, sf, name), ["region_id"]), GRID)


def _cov(fx: str, key: str = "region_id") -> str:
    """Exact cover of unit cells by boxes."""
    return f"""SELECT {key}, CAST(15 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col,
        (least(maxx, x + 1) - greatest(minx, x)) * (least(maxy, y + 1) - greatest(miny, y)) AS frac
        FROM (SELECT *, unnest(range(CAST(floor(miny) AS BIGINT), CAST(ceil(maxy) AS BIGINT))) AS y FROM (
              SELECT *, unnest(range(CAST(floor(minx) AS BIGINT), CAST(ceil(maxx) AS BIGINT))) AS x FROM {fx}))
        WHERE x >= 0 AND x < 32 AND y >= 0 AND y < 16"""


def _fine(fx: str, key: str) -> str:
    """Boxes on multiples of 1/8 as the set of their 1/8 cells."""
    return f"""SELECT DISTINCT {key}, x, y FROM (SELECT *, unnest(range(CAST(miny * 8 AS BIGINT), CAST(maxy * 8 AS BIGINT))) AS y FROM (
        SELECT *, unnest(range(CAST(minx * 8 AS BIGINT), CAST(maxx * 8 AS BIGINT))) AS x FROM {fx}))"""


# ----------------------------------------------------------------------------------------- coverage
def _joined(boxes: str, key: str, name: str) -> str:
    """CTEs that give boxes (``key, i, minx ... maxy``) their part: those that share more than a point, on and on; ``<name>_part (key, i, part)``."""
    meet = "least(p.maxx, q.maxx) >= greatest(p.minx, q.minx) AND least(p.maxy, q.maxy) >= greatest(p.miny, q.miny) AND (least(p.maxx, q.maxx) > greatest(p.minx, q.minx) OR least(p.maxy, q.maxy) > greatest(p.miny, q.miny))"
    return f"""{name}_b AS ({boxes}), {name}_e AS (SELECT p.i AS u, q.i AS v FROM {name}_b p JOIN {name}_b q ON p.{key} = q.{key} AND p.i <> q.i AND {meet}),
    {name}_r AS (SELECT i, i AS l FROM {name}_b UNION SELECT v, l FROM {name}_r JOIN {name}_e ON u = i WHERE l < v),
    {name}_part AS (SELECT {key}, b.i, min(l) AS part FROM {name}_r r JOIN {name}_b b ON b.i = r.i GROUP BY ALL)"""


def _cell_parts(cells: str, key: str, before: str = "") -> str:
    """Parts (cells that share a side), holes, area and bounds of sets of 1/8 cells, as ``WITH RECURSIVE``."""
    return f"""WITH RECURSIVE {before} c AS ({cells}),
    run AS (SELECT {key}, y, min(x) AS a, max(x) AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY {key}, y ORDER BY x) AS g FROM c) GROUP BY {key}, y, g),
    n AS (SELECT *, row_number() OVER (ORDER BY {key}, y, a) AS i FROM run),
    e AS (SELECT p.i AS u, q.i AS v FROM n p JOIN n q ON p.{key} = q.{key} AND abs(p.y - q.y) = 1 AND p.a <= q.b AND q.a <= p.b),
    r AS (SELECT i, i AS l FROM n UNION SELECT v, l FROM r JOIN e ON u = i WHERE l < v),
    part AS (SELECT {key}, count(DISTINCT l) AS parts FROM (SELECT i, min(l) AS l FROM r GROUP BY i) JOIN n USING (i) GROUP BY {key}),
    up AS (SELECT p.{key}, p.x, p.y FROM c p JOIN c q ON p.{key} = q.{key} AND p.x = q.x AND q.y = p.y + 1),
    block AS (SELECT p.{key}, count(*) AS blocks FROM up p JOIN up q ON p.{key} = q.{key} AND p.y = q.y AND q.x = p.x + 1 GROUP BY ALL),
    total AS (SELECT {key}, count(*) AS cells, min(x) / 8 AS minx, min(y) / 8 AS miny, (max(x) + 1) / 8 AS maxx, (max(y) + 1) / 8 AS maxy FROM c GROUP BY {key}),
    side AS (SELECT {key}, count(*) AS sides FROM up GROUP BY {key}), line AS (SELECT {key}, count(*) AS runs FROM run GROUP BY {key})
    SELECT t.{key}, parts, CASE WHEN parts > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
        CAST(parts - (cells - (cells - runs) - coalesce(sides, 0) + coalesce(blocks, 0)) AS BIGINT) AS holes, CAST(cells AS DOUBLE) / 64 AS area, minx, miny, maxx, maxy
    FROM total t JOIN part p ON p.{key} = t.{key} JOIN line l ON l.{key} = t.{key} LEFT JOIN side s ON s.{key} = t.{key} LEFT JOIN block b ON b.{key} = t.{key}"""


def _shape(key: str):
    """What tells a geometry apart: parts, type, holes, area, bounds."""
    b = G.bounds("geometry")
    parts, ring_count = F.size("geometry"), F.size(F.flatten("geometry"))
    return [key, parts.cast("bigint").alias("parts"), G.geometry_type("geometry").alias("kind"), (ring_count - parts).cast("bigint").alias("holes"), G.area("geometry").alias("area"), *[b[c].alias(c) for c in ("minx", "miny", "maxx", "maxy")]]


@query("r7_fractional_coverage", _cov("fx_boxes"))
def _(spark, sf):
    return mask_of(spark, sf, "fx_boxes")


@query("r7_coverage_complete_layer", _cov("fx_tiles"))
def _(spark, sf):
    return mask_of(spark, sf, "fx_tiles")


@query("r7_coverage_many_regions", f"SELECT row, col, count(*) AS regions, sum(frac) AS total FROM ({_cov('fx_parcels')}) GROUP BY row, col")
def _(spark, sf):
    return mask_of(spark, sf, "fx_parcels").groupBy("row", "col").agg(F.count("*").alias("regions"), F.sum("frac").alias("total"))


@query("r6_cell_classes", f"SELECT region_id, count(*) FILTER (frac = 1) AS whole, count(*) FILTER (frac < 1) AS partial FROM ({_cov('fx_boxes')}) GROUP BY region_id")
def _(spark, sf):
    return mask_of(spark, sf, "fx_boxes").groupBy("region_id").agg(F.count_if(F.col("frac") == 1).alias("whole"), F.count_if(F.col("frac") < 1).alias("partial"))


@query(
    "r7_coverage_sloped_edges",
    """WITH t AS (SELECT region_id, minx AS a, miny AS b FROM fx_boxes),
    c AS (SELECT *, greatest(a, x) AS lo, least(a + 2, x + 1) AS hi, greatest(b, CAST(y AS DOUBLE)) AS f, CAST(y + 1 AS DOUBLE) AS t FROM (
          SELECT *, unnest(range(CAST(floor(b) AS BIGINT), CAST(ceil(b + 2) AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(floor(a) AS BIGINT), CAST(ceil(a + 2) AS BIGINT))) AS x FROM t))),
    v AS (SELECT *, b + lo - a AS yl, b + hi - a AS yh FROM c),
    w AS (SELECT region_id, x, y,
          (CASE WHEN yh <= f THEN 0 WHEN yh <= t THEN (yh - f) * (yh - f) / 2 ELSE (t - f) * (t - f) / 2 + (yh - t) * (t - f) END)
          - (CASE WHEN yl <= f THEN 0 WHEN yl <= t THEN (yl - f) * (yl - f) / 2 ELSE (t - f) * (t - f) / 2 + (yl - t) * (t - f) END) AS frac FROM v)
    SELECT region_id, CAST(15 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col, CAST(frac AS DOUBLE) AS frac FROM w WHERE frac > 0 AND x < 32 AND y < 16""",
)
def _(spark, sf):
    a, b = F.col("minx"), F.col("miny")
    ring = F.array(F.array(F.array(G.point(a, b), G.point(a + 2, b), G.point(a + 2, b + 2), G.point(a, b))))
    t = load(spark, sf, "fx_boxes").select("region_id", ring.alias("geometry"))
    return coverage.coverage(G.edges(t, ["region_id"]), GRID)


@query("r7_coverage_with_holes", f"SELECT o.region_id, o.row, o.col, CAST(o.frac - coalesce(i.frac, 0) AS DOUBLE) AS frac FROM ({_cov('fx_tiles')}) o LEFT JOIN ({_cov('(SELECT region_id, minx + 1.5 AS minx, miny + 0.75 AS miny, maxx - 1.5 AS maxx, maxy - 0.75 AS maxy FROM fx_tiles)')}) i ON o.region_id = i.region_id AND o.row = i.row AND o.col = i.col WHERE o.frac > coalesce(i.frac, 0)")
def _(spark, sf):
    t = load(spark, sf, "fx_tiles")
    outer, hole = G.box("minx", "miny", "maxx", "maxy"), G.box(F.col("minx") + 1.5, F.col("miny") + 0.75, F.col("maxx") - 1.5, F.col("maxy") - 0.75)
    shape = F.array(F.array(outer[0][0], F.reverse(hole[0][0])))
    return coverage.coverage(G.edges(t.select("region_id", shape.alias("geometry")), ["region_id"]), GRID)


@query("a6_sum_over_parts", f"SELECT grp, row, col, sum(frac) AS frac FROM ({_cov('fx_tiles', 'grp')}) GROUP BY grp, row, col")
def _(spark, sf):
    own = layers.dissolve(layer(spark, sf, "fx_tiles"), "grp", "row_id", ["row_id"])
    return coverage.coverage(G.edges(own, ["grp"]), GRID, "grp")


@query("a7_cell_totals", f"SELECT row, col, sum(frac) AS total FROM ({_cov('fx_boxes')}) GROUP BY row, col")
def _(spark, sf):
    return coverage.cell_totals(mask_of(spark, sf, "fx_boxes"))


@query("a8_normalise", f"SELECT region_id, row, col, frac / sum(frac) OVER (PARTITION BY row, col) AS frac FROM ({_cov('fx_boxes')})")
def _(spark, sf):
    return coverage.normalise(mask_of(spark, sf, "fx_boxes")).select("region_id", "row", "col", "frac")


@query("a9_dense_mask", f"""WITH m AS ({_cov('fx_boxes')}), g AS (SELECT region_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM (
    SELECT *, unnest(range(32)) AS col FROM (SELECT region_id, unnest(range(16)) AS row FROM fx_boxes WHERE region_id IN ('N01', 'N07'))))
    SELECT g.region_id, g.row, g.col, CAST(coalesce(m.frac, 0) AS FLOAT) AS frac FROM g LEFT JOIN m ON g.region_id = m.region_id AND g.row = m.row AND g.col = m.col""")
def _(spark, sf):
    two = load(spark, sf, "fx_boxes").filter("region_id in ('N01', 'N07')")
    return coverage.densify(mask_of(spark, sf, "fx_boxes").filter("region_id in ('N01', 'N07')"), GRID, two, normalised=False)


@query("a9_dense_mask_all_regions", f"""WITH m AS ({_cov('fx_boxes')}), g AS (SELECT region_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM (
    SELECT *, unnest(range(32)) AS col FROM (SELECT region_id, unnest(range(16)) AS row FROM fx_boxes)))
    SELECT g.region_id, g.row, g.col, CAST(coalesce(m.frac, 0) AS FLOAT) AS frac FROM g LEFT JOIN m ON g.region_id = m.region_id AND g.row = m.row AND g.col = m.col""")
def _(spark, sf):
    return coverage.densify(mask_of(spark, sf, "fx_boxes"), GRID, load(spark, sf, "fx_boxes"), normalised=False)


@query("mask_region_totals", f"SELECT m.region_id, n_name AS name, cells, covered FROM (SELECT region_id, count(*) AS cells, sum(frac) AS covered FROM ({_cov('fx_boxes')}) GROUP BY region_id) m JOIN nation ON m.region_id = concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0'))")
def region_totals(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("concat('N', lpad(cast(n_nationkey as string), 2, '0')) as region_id", "n_name as name")
    return coverage.summary(spark, mask_of(spark, sf, "fx_boxes"), GRID).drop("area").join(names, "region_id").select("region_id", "name", "cells", "covered")


@query("g17_wrap_longitude", """WITH b AS (SELECT region_id, minx - 12 AS minx, miny, maxx - 12 AS maxx, maxy FROM fx_boxes)
    SELECT region_id, (maxx - minx) * (maxy - miny) AS area, CAST(CASE WHEN maxx > -0.25 THEN greatest(minx, -0.25) ELSE minx + 360 END AS DOUBLE) AS lowest,
           CAST(CASE WHEN minx < -0.25 THEN least(maxx, -0.25) + 360 ELSE maxx END AS DOUBLE) AS highest FROM b""")
def _(spark, sf):
    b = load(spark, sf, "fx_boxes").withColumns({"minx": F.col("minx") - 12, "maxx": F.col("maxx") - 12})
    w = coverage.wrap_longitude(G.edges(G.from_boxes(b), ["region_id"]), -0.25, ["region_id"])
    # edges that both halves leave on the cut cancel; only what encloses area counts for the bounds
    net = w.withColumn("up", F.col("y1") > F.col("y0")).filter("y0 <> y1").groupBy("region_id", "x0", F.least("y0", "y1").alias("lo"), F.greatest("y0", "y1").alias("hi")).agg(F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("n")).filter("n <> 0")
    ends = net.groupBy("region_id").agg(F.min("x0").alias("lowest"), F.max("x0").alias("highest"))
    return w.groupBy("region_id").agg(G.bag_area().alias("area")).join(ends, "region_id").select("region_id", "area", "lowest", "highest")


# --------------------------------------------------------------------------------------------- grid
@query("r1_r2_grid", "SELECT region_id, CAST(floor((maxx - minx) / 0.375) AS INTEGER) AS width, CAST(floor((maxy - miny) / 0.375) AS INTEGER) AS height, (maxx - minx) / floor((maxx - minx) / 0.375) AS dx, (maxy - miny) / floor((maxy - miny) / 0.375) AS dy FROM fx_parcels")
def _(spark, sf):
    # a grid of its own for each layer's bounds
    width, dx = sizes(F.col("minx"), F.col("maxx"), 0.375)
    height, dy = sizes(F.col("miny"), F.col("maxy"), 0.375)
    return load(spark, sf, "fx_parcels").select("region_id", width.alias("width"), height.alias("height"), dx.alias("dx"), dy.alias("dy"))


_OBS_CELLS = "(SELECT DISTINCT CAST(floor((16 - lat) / 0.5) AS INTEGER) AS row, CAST(floor(lon / 0.5) AS INTEGER) AS col FROM fx_obs WHERE lon >= 0 AND lon < 32 AND lat > 0 AND lat <= 16)"
_HALF = Grid(0, 0, 32, 16, 0.5)


def _cells_of(spark, sf):
    return coverage.to_cells(load(spark, sf, "fx_obs"), _HALF).select("row", "col").distinct()


@query("r3_cell_bounds", f"SELECT row, col, col / 2.0::DOUBLE AS x0, 16 - (row + 1) / 2.0::DOUBLE AS y0, (col + 1) / 2.0::DOUBLE AS x1, 16 - row / 2.0::DOUBLE AS y1 FROM {_OBS_CELLS}")
def _(spark, sf):
    return _cells_of(spark, sf).withColumns(_HALF.box_of(F.col("row"), F.col("col")))


@query("r4_cell_centres", f"SELECT row, col, (col + 0.5::DOUBLE) / 2 AS lon, 16 - (row + 0.5::DOUBLE) / 2 AS lat FROM {_OBS_CELLS}")
def _(spark, sf):
    return _cells_of(spark, sf).withColumns(_HALF.centre_of(F.col("row"), F.col("col")))


# ----------------------------------------------------------------------------------------- geometry
@query("g1_g6_g7_box_area_bounds", "SELECT region_id, (maxx - minx) * (maxy - miny) AS area, minx, miny, maxx, maxy FROM fx_boxes")
def _(spark, sf):
    t = load(spark, sf, "fx_boxes").select("region_id", G.box("maxx", "maxy", "minx", "miny").alias("geometry"))  # reversed bounds
    return t.select("region_id", G.area("geometry").alias("area"), G.bounds("geometry").alias("b")).select("region_id", "area", "b.*")


@query("g5_translate", "SELECT region_id, minx + 360 AS minx, maxx + 360 AS maxx, miny FROM fx_boxes")
def _(spark, sf):
    b = G.bounds(G.translate("geometry", 360.0))
    return layer(spark, sf, "fx_boxes").select("region_id", b.alias("b")).select("region_id", "b.minx", "b.maxx", "b.miny")


@query("g2_clip_to_box", "SELECT region_id, greatest(CAST(0 AS DOUBLE), least(maxx, 20.5) - greatest(minx, 5.25)) * greatest(CAST(0 AS DOUBLE), least(maxy, 9) - greatest(miny, 2.125)) AS area FROM fx_boxes")
def _(spark, sf):
    c = coverage.clip_box(G.edges(layer(spark, sf, "fx_boxes"), ["region_id"]), 5.25, 2.125, 20.5, 9.0, ["region_id"])
    area = c.groupBy("region_id").agg(G.bag_area().alias("area"))
    return load(spark, sf, "fx_boxes").select("region_id").join(area, "region_id", "left").select("region_id", F.coalesce("area", F.lit(0.0)).alias("area"))


@query("g11_g12_parts", f"WITH RECURSIVE {_joined('SELECT grp, row_id AS i, minx, miny, maxx, maxy FROM fx_boxes', 'grp', 't')} SELECT grp, count(DISTINCT part) AS parts, CASE WHEN count(DISTINCT part) > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM t_part GROUP BY grp")
def _(spark, sf):
    d = layers.dissolve(layer(spark, sf, "fx_boxes"), "grp", "row_id", ["row_id"]).withColumn("kind", G.geometry_type("geometry"))
    return G.parts(d).groupBy("grp", "kind").agg(F.count("*").alias("parts")).select("grp", "parts", "kind")


@query("g14_mercator", "SELECT site_id, round(radians(x) * 6378137.0, 6) AS mx, round(6378137.0 * asinh(tan(radians(y))), 6) AS my, round(x, 9) AS lon, round(y, 9) AS lat FROM fx_sites")
def _(spark, sf):
    t = load(spark, sf, "fx_sites")
    mx, my = G.mercator(F.col("x"), F.col("y"))
    lon, lat = G.unmercator(mx, my)
    return t.select("site_id", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("f9_f10_g8_g9_validity", "SELECT region_id, row_id % 3 = 0 AS empty, row_id % 3 = 1 AS valid FROM fx_boxes")
def _(spark, sf):
    t = layer(spark, sf, "fx_boxes")
    flat = G.box("minx", "miny", "maxx", "miny")  # no area
    shape = F.when(F.col("row_id") % 3 == 0, F.array().cast(G.GEOMETRY)).when(F.col("row_id") % 3 == 1, F.col("geometry")).otherwise(flat)
    return t.select("region_id", G.is_empty(shape).alias("empty"), G.is_valid(shape).alias("valid"))


@query("r5_all_touched", """SELECT region_id, CAST(15 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col FROM (SELECT *, unnest(range(greatest(CAST(ceil(miny) AS BIGINT) - 1, 0), least(CAST(floor(maxy) AS BIGINT), 15) + 1)) AS y FROM (
    SELECT *, unnest(range(greatest(CAST(ceil(minx) AS BIGINT) - 1, 0), least(CAST(floor(maxx) AS BIGINT), 31) + 1)) AS x FROM fx_parcels))""")
def _(spark, sf):
    return coverage.touched(G.edges(layer(spark, sf, "fx_parcels"), ["region_id"]), GRID)


@query("g16_boundary", "SELECT region_id, CAST(1 AS BIGINT) AS lines, 2 * (maxx - minx + maxy - miny) AS length FROM fx_parcels")
def _(spark, sf):
    lines = G.boundary("geometry")
    length = F.aggregate(F.transform(lines, G.line_length), F.lit(0.0), lambda acc, v: acc + v)
    return layer(spark, sf, "fx_parcels").select("region_id", F.size(lines).cast("bigint").alias("lines"), length.alias("length"))


# each box with bumps on two sides, one lower and one higher than the tolerance
_BUMP = "CASE WHEN row_id % 2 = 0 THEN 0.0078125 ELSE 0.25 END"


@query("g15_simplify", f"SELECT region_id, CAST(CASE WHEN row_id % 2 = 0 THEN 5 ELSE 8 END AS BIGINT) AS points, CASE WHEN row_id % 2 = 0 THEN w * h ELSE w * h - w * {_BUMP} / 8 END AS area FROM (SELECT *, maxx - minx AS w, maxy - miny AS h FROM fx_parcels)")
def _(spark, sf):
    t = load(spark, sf, "fx_parcels")
    at = lambda u, v, more=0.0: G.point(F.col("minx") + (F.col("maxx") - F.col("minx")) * u, F.col("miny") + (F.col("maxy") - F.col("miny")) * v + more)
    bump = F.expr(_BUMP).cast("double")
    ring = F.array(at(0, 0), at(0.25, 0), at(0.375, 0, bump), at(0.5, 0), at(1, 0), at(1, 0.5), at(1, 1), at(0, 1), at(0, 0))
    out = simplify.simplify(t.withColumn("geometry", F.array(F.array(ring))), ["region_id"], 0.015625)
    return out.select("region_id", F.size(F.col("geometry")[0][0]).cast("bigint").alias("points"), G.area("geometry").alias("area"))


@query("f10_g9_validity_reasons", """SELECT region_id, row_id % 10 IN (0, 1, 2) AS valid, CASE row_id % 10 WHEN 3 THEN 'Self-intersection' WHEN 4 THEN 'Hole outside shell or in another hole' WHEN 5 THEN 'Nested shells'
    WHEN 6 THEN 'Self-intersection' WHEN 7 THEN 'Self-intersection' WHEN 8 THEN 'Hole outside shell or in another hole' WHEN 9 THEN 'Ring self-intersection' END AS reason FROM fx_parcels""")
def _(spark, sf):
    # a box; with a hole; with a part that touches its corner; crossing; hole outside; nested; spike; shared side; hole in a hole; touching itself
    t = load(spark, sf, "fx_parcels").repartition("region_id")
    p = lambda u, v: G.point(F.col("minx") + (F.col("maxx") - F.col("minx")) * u, F.col("miny") + (F.col("maxy") - F.col("miny")) * v)
    ring = lambda *c: F.array(*[p(u, v) for u, v in (*c, c[0])])
    at = lambda a, b, c, d: ((a, b), (c, b), (c, d), (a, d))
    box = lambda *b: ring(*at(*b))
    hole = lambda *b: ring(*at(*b)[::-1])
    shapes = (
        [[box(0, 0, 1, 1)]], [[box(0, 0, 1, 1), hole(0.25, 0.25, 0.75, 0.5)]], [[box(0, 0, 1, 1)], [box(1, 1, 2, 2)]], [[ring((0, 0), (1, 1), (1, 0), (0, 1))]],
        [[box(0, 0, 1, 1), hole(5, 0, 5.5, 0.5)]], [[box(0, 0, 1, 1)], [box(0.25, 0.25, 0.5, 0.5)]], [[ring((0, 0), (1, 0), (1, 0.5), (2, 0.5), (1, 0.5), (1, 1), (0, 1))]],
        [[box(0, 0, 1, 1)], [box(1, 0, 2, 1)]], [[box(0, 0, 1, 1), hole(0.25, 0.25, 0.75, 0.75), hole(0.375, 0.375, 0.5, 0.5)]], [[ring((0, 0), (1, 0), (1, 1), (0.5, 0), (0, 1))]],
    )
    geometry = F.coalesce(*[F.when(F.col("row_id") % 10 == k, F.array(*[F.array(*part) for part in s])) for k, s in enumerate(shapes)])
    return validity.check(t.withColumn("geometry", geometry), ["region_id"]).select("region_id", "valid", "reason")


@query("f7_f8_null_and_flat_geometry", "SELECT region_id FROM fx_boxes WHERE row_id % 3 = 1")
def _(spark, sf):
    flat = G.box("minx", "miny", "maxx", "miny")
    shape = F.when(F.col("row_id") % 3 == 1, F.col("geometry")).when(F.col("row_id") % 3 == 2, flat)
    return layer(spark, sf, "fx_boxes").withColumn("geometry", shape).filter("geometry is not null").filter(G.area("geometry") > 0).select("region_id")


@query("g10_repair_overlapping_parts", f"SELECT grp, CAST(count(*) AS DOUBLE) / 64 AS area FROM ({_fine('fx_boxes', 'grp')}) GROUP BY grp")
def _(spark, sf):
    # parts of one region that overlap, as a layer may hold them
    e = G.edges(layer(spark, sf, "fx_boxes"), ["grp", "region_id"])
    return boolean.repair(e, ["grp"]).groupBy("grp").agg(G.bag_area().alias("area"))


@query("a1_g4_dissolve_overlapping", f"SELECT grp, CAST(x // 8 AS INTEGER) AS col, CAST(15 - y // 8 AS INTEGER) AS row, CAST(count(*) AS DOUBLE) / 64 AS frac FROM ({_fine('fx_boxes', 'grp')}) GROUP BY ALL")
def _(spark, sf):
    e = layers.dissolve_edges(G.edges(layer(spark, sf, "fx_boxes"), ["grp", "region_id"]), ["grp"])
    return coverage.coverage(e, GRID, "grp")


@query("a3_union_all", f"SELECT CAST(count(*) AS DOUBLE) / 64 AS area FROM ({_fine('fx_boxes', '1 AS k')})")
def _(spark, sf):
    e = G.edges(layer(spark, sf, "fx_boxes"), ["region_id"]).withColumn("k", F.lit(1))
    return layers.dissolve_edges(e, ["k"]).agg(G.bag_area().alias("area"))


@query("j3_intersection_join", """SELECT a.region_id AS box_id, b.region_id AS tile_id, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area
    FROM fx_boxes a JOIN fx_tiles b ON a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy""")
def _(spark, sf):
    a, b = layer(spark, sf, "fx_boxes").withColumnRenamed("region_id", "box_id"), layer(spark, sf, "fx_tiles").withColumnRenamed("region_id", "tile_id")
    return layers.overlay_intersection(a, b, "box_id", "tile_id").groupBy("box_id", "tile_id").agg(G.bag_area().alias("area"))


@query("j5_g3_gaps", f"SELECT t.region_id, CAST(count(*) AS DOUBLE) / 64 AS area FROM ({_fine('fx_tiles', 'region_id')}) t ANTI JOIN (SELECT DISTINCT x, y FROM ({_fine('fx_boxes', 'region_id')})) b USING (x, y) GROUP BY t.region_id")
def _(spark, sf):
    return layers.gaps(layer(spark, sf, "fx_tiles"), layer(spark, sf, "fx_boxes"), "region_id").groupBy("region_id").agg(G.bag_area().alias("area"))


@query("j4_nearest", """WITH d AS (SELECT site_id, region_id, sqrt(pow(greatest(minx - x, x - maxx, 0), 2) + pow(greatest(miny - y, y - maxy, 0), 2)) AS distance FROM fx_sites, fx_boxes),
    r AS (SELECT *, rank() OVER (PARTITION BY site_id ORDER BY round(distance, 9)) AS r FROM d) SELECT site_id, region_id, round(distance, 9) AS distance FROM r WHERE r = 1""")
def _(spark, sf):
    sites = load(spark, sf, "fx_sites").select("site_id", G.box("x", "y", "x", "y").alias("geometry"))
    return predicates.nearest(sites, layer(spark, sf, "fx_boxes"), "site_id", "region_id", project=False).withColumn("distance", F.round("distance", 9))


_BOXES = ((0, 2.5, 1.5, 6.25, 4.0), (1, 20.0, 9.0, 12.0, 14.5), (2, 13.125, 7.125, 13.25, 7.25))
_BOX_SQL = " UNION ALL ".join(f"SELECT {i} AS box_id, {min(a, c)} AS x0, {min(b, d)} AS y0, {max(a, c)} AS x1, {max(b, d)} AS y1" for i, a, b, c, d in _BOXES)


@query("f3_g13_any_box", f"WITH q AS ({_BOX_SQL}) SELECT DISTINCT region_id FROM fx_boxes, q WHERE minx <= x1 AND x0 <= maxx AND miny <= y1 AND y0 <= maxy")
def _(spark, sf):
    boxes = spark.createDataFrame([(i, *map(float, b)) for i, *b in _BOXES], "box_id int, minx double, miny double, maxx double, maxy double")
    return predicates.touching(layer(spark, sf, "fx_boxes").select("region_id", "geometry"), boxes, ["region_id"]).select("region_id").distinct()


# --------------------------------------------------------------------------------------- attributes
@query("s2_null_tokens", "SELECT id, name, nullif(ne_id, '') AS ne_id, CASE WHEN iso3_code NOT IN ('N/A') THEN iso3_code END AS iso3_code, nullif(ison_code, '') AS ison_code, num_id FROM fx_codes")
def _(spark, sf):
    return harmonise.null_tokens(load(spark, sf, "fx_codes"))


def codes(spark, sf):
    return harmonise.null_tokens(load(spark, sf, "fx_codes"))


_CODES = "codes AS (SELECT id, name, nullif(ne_id, '') AS ne_id, nullif(iso3_code, 'N/A') AS iso3_code, nullif(ison_code, '') AS ison_code, num_id FROM fx_codes)"


@query("p1_prepare", "SELECT id AS ID, name AS NAME, iso3_code AS ISO3_CODE, CAST(NULL AS STRING) AS ISO2_CODE, CAST(NULL AS STRING) AS ISON_CODE, CAST(NULL AS STRING) AS NUM_ID, CAST(NULL AS STRING) AS OL_NAME, CAST(NULL AS STRING) AS SOURCE FROM fx_codes")
def _(spark, sf):
    return harmonise.prepare(load(spark, sf, "fx_codes"), harmonise.SEAS_SCHEMA, {"id": "ID", "name": "NAME", "iso3_code": "ISO3_CODE"}).withColumn("NUM_ID", F.col("NUM_ID").cast("string"))


@query("p1_prepare_unrestricted", "SELECT CAST(NULL AS STRING) AS ID, name AS NAME, CAST(NULL AS STRING) AS ISO3_CODE, CAST(NULL AS STRING) AS ISO2_CODE, CAST(NULL AS STRING) AS ISON_CODE, CAST(NULL AS STRING) AS NUM_ID, CAST(NULL AS STRING) AS WB_A3, id AS HASC_0, CAST(NULL AS STRING) AS WB_REGION, CAST(NULL AS STRING) AS WB_STATUS, 'x' AS SOVEREIGN, 'World Bank Official Boundaries' AS SOURCE FROM fx_codes")
def _(spark, sf):
    t = load(spark, sf, "fx_codes").select(F.col("name"), F.col("id").alias("HASC_0"), F.lit("x").alias("SOVEREIGN"))
    return harmonise.prepare(t, harmonise.WORLD_BANK_SCHEMA, {"name": "NAME"}, {"SOURCE": harmonise.SOURCES["world_bank"]}, restrict=False).withColumn("NUM_ID", F.col("NUM_ID").cast("string"))


@query("p2_p3_p4_columns", "SELECT id, name, name AS ol_name, 'GOAS v1' AS source FROM fx_codes")
def _(spark, sf):
    return load(spark, sf, "fx_codes").drop("ne_id", "iso3_code", "ison_code", "num_id").withColumn("ol_name", F.col("name")).withColumn("source", F.lit(harmonise.SOURCES["goas"]))


@query("p5_p6_fallbacks", f"WITH {_CODES} SELECT id, coalesce(iso3_code, name) AS label, coalesce(ne_id, 'Unassigned Marine Area') AS area FROM codes")
def _(spark, sf):
    return codes(spark, sf).select("id", F.coalesce("iso3_code", "name").alias("label"), layers.default_name(F.col("ne_id")).alias("area"))


@query("p7_sentinel", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS STRING) END AS code, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS STRING) END AS num FROM nation")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey as k", "case when n_nationkey % 4 = 0 then '-99' else cast(n_nationkey as string) end as code", "case when n_nationkey % 5 = 0 then -99 else n_nationkey end as num")
    return harmonise.sentinel_to_null(t, ["code", "num"]).withColumn("num", F.col("num").cast("string"))


@query("p8_p9_p10_updates", "SELECT CASE id WHEN 'N03' THEN 'X03' ELSE id END AS id, CASE WHEN name = 'FRANCE' THEN 'FRA' ELSE iso3_code END AS iso3_code, CASE WHEN num_id = 5 THEN 'cell' ELSE name END AS name FROM fx_codes")
def _(spark, sf):
    t = load(spark, sf, "fx_codes").replace({"N03": "X03"}, subset=["id"])
    return t.withColumn("iso3_code", F.when(F.col("name") == "FRANCE", "FRA").otherwise(F.col("iso3_code"))).withColumn("name", F.when(F.col("num_id") == 5, "cell").otherwise(F.col("name"))).select("id", "iso3_code", "name")


@query("p11_number_chain", "SELECT id, CAST(CAST(try_cast(trim(ison_code) AS DOUBLE) AS BIGINT) AS STRING) AS ison, CAST(CAST(try_cast(trim(iso3_code) AS DOUBLE) AS BIGINT) AS STRING) AS iso3, CAST(CAST(try_cast(ne_id AS DOUBLE) AS BIGINT) AS STRING) AS ne FROM fx_codes")
def _(spark, sf):
    n = lambda c: harmonise.to_number(c).cast("string")
    return load(spark, sf, "fx_codes").select("id", n(F.col("ison_code")).alias("ison"), n(F.col("iso3_code")).alias("iso3"), n(F.col("ne_id")).alias("ne"))


_ISO = f"{_CODES}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iso3_code ORDER BY num_id) AS r FROM codes WHERE iso3_code IS NOT NULL) WHERE r = 1), iso AS (SELECT iso3_code AS alpha3, substr(id, 2, 2) AS alpha2, lpad(CAST(CAST(CAST(ison_code AS DOUBLE) AS BIGINT) AS STRING), 3, '0') AS numeric FROM one)"


@query("s5_iso_dimension", f"WITH {_ISO} SELECT * FROM iso")
def iso(spark, sf):
    return harmonise.iso_dimension(codes(spark, sf).withColumn("iso2_code", F.substring("id", 2, 2)))


@query("p12_iso_enrichment", f"WITH {_ISO} SELECT c.id AS ID, c.iso3_code AS ISO3_CODE, alpha2 AS ISO2_CODE, numeric AS ISON_CODE FROM codes c LEFT JOIN iso ON c.iso3_code = alpha3")
def _(spark, sf):
    t = codes(spark, sf).select(F.col("id").alias("ID"), F.col("iso3_code").alias("ISO3_CODE"), F.lit("old").alias("ISO2_CODE"), F.lit("old").alias("ISON_CODE"))
    return harmonise.enrich_iso(t, iso(spark, sf))


@query("p13_sea_ids", "SELECT p_partkey AS k, 'OC_' || array_to_string(list_transform(list_filter(string_split_regex(trim(p_name), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1])), '') AS id FROM part")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), harmonise.sea_id(F.col("p_name")).alias("id"))


@query("f1_f2_f6_filters", f"WITH {_CODES} SELECT id, name FROM codes WHERE (name = 'CHINA' OR id IN ('NA', 'N02', 'N04', 'N13')) AND NOT coalesce(iso3_code = 'C04', false)")
def _(spark, sf):
    t = codes(spark, sf).filter((F.col("name") == "CHINA") | F.col("id").isin("NA", "N02", "N04", "N13"))
    return harmonise.delete_where(t, F.col("iso3_code") == "C04").select("id", "name")


@query("f4_f5_keep_first", f"WITH {_CODES} SELECT iso3_code, min(num_id) AS num_id FROM codes WHERE iso3_code IS NOT NULL GROUP BY iso3_code")
def _(spark, sf):
    return harmonise.first_by(codes(spark, sf), "iso3_code", "num_id").select("iso3_code", "num_id")


_PRJ = ('GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0]]', 'GEOGCS["WGS 84", DATUM["WGS_1984", SPHEROID["WGS 84", 6378137.0, 298.257223563]], PRIMEM["Greenwich", 0.0]]\n', 'PROJCS["WGS 84 / Pseudo-Mercator"]')


@query("f11_f12_alignment", "SELECT 'fx_boxes' AS layer, true AS same_crs, true AS same_columns, count(*) AS regions FROM fx_boxes UNION ALL SELECT 'fx_plain', false, false, count(*) FROM fx_boxes")
def _(spark, sf):
    # layers as files, each beside its own reference system, held against the tiles
    base = f"{scratch.folder(spark)}/layers-{uuid.uuid4().hex}"
    tiles, boxes = (layer(spark, sf, n).select("region_id", "grp", "geometry") for n in ("fx_tiles", "fx_boxes"))
    for t, name, prj in zip((tiles, boxes, boxes.drop("grp")), ("fx_tiles", "fx_boxes", "fx_plain"), _PRJ, strict=True):
        shapefile.write_shapefile(t, f"{base}/{name}.shp", prj)
    first, out = shapefile.read_shapefile(spark, f"{base}/fx_tiles.shp"), None
    for name in ("fx_boxes", "fx_plain"):
        other = shapefile.read_shapefile(spark, f"{base}/{name}.shp")
        same = shapefile.aligned(f"{base}/fx_tiles.shp", f"{base}/{name}.shp", strict=False)
        row = other.agg(F.lit(name).alias("layer"), F.lit(same).alias("same_crs"), F.lit(first.columns == other.columns).alias("same_columns"), F.count("*").alias("regions"))
        out = row if out is None else out.unionByName(row)
    return out


@query("j1_lookup", f"WITH {_CODES} SELECT b.region_id, CAST(c.num_id AS STRING) AS NUM_ID FROM fx_boxes b LEFT JOIN codes c ON b.region_id = c.id")
def _(spark, sf):
    return harmonise.lookup(load(spark, sf, "fx_boxes"), codes(spark, sf), "region_id", "id", "num_id", "NUM_ID").select("region_id", F.col("NUM_ID").cast("string"))


@query("j1_lookup_keep_first", f"WITH {_CODES} SELECT o_orderkey AS k, (SELECT min_by(id, num_id) FROM codes WHERE iso3_code = concat('C', lpad(CAST(o_orderkey % 25 AS STRING), 2, '0'))) AS ID FROM orders")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as k", "concat('C', lpad(cast(o_orderkey % 25 as string), 2, '0')) as iso3")
    return harmonise.lookup(t, codes(spark, sf), "iso3", "iso3_code", "id", "ID", order="num_id").select("k", "ID")


@query("j2_dictionary_join", "SELECT c_custkey AS k, coalesce((SELECT max(n_name) FROM nation WHERE lower(n_name) = lower(c_mktsegment) OR (n_nationkey = 3 AND c_mktsegment = 'BUILDING')), 'Other') AS parent FROM customer")
def _(spark, sf):
    names = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("case when n_nationkey = 3 then 'Building' else n_name end as sea", "n_name as parent")
    t = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as k", "c_mktsegment as name")
    return harmonise.dictionary_join(t, names, "name", "sea", "parent", "parent").select("k", "parent")


@query("j7_first_match_or_default", "SELECT 'T03' AS asked, coalesce(max(name), 'Unknown') AS name FROM fx_codes WHERE id = 'T03' UNION ALL SELECT 'N03', coalesce(max(name), 'Unknown') FROM fx_codes WHERE id = 'N03'")
def _(spark, sf):
    t = load(spark, sf, "fx_codes")
    return tables.describe(t, "id", "T03", "name").select(F.lit("T03").alias("asked"), "name").union(tables.describe(t, "id", "N03", "name").select(F.lit("N03"), "name"))


@query("j8_select_region", f"SELECT * FROM ({_cov('fx_boxes')}) WHERE region_id = 'N07'")
def _(spark, sf):
    # the filter reaches the scan: other regions' edges are never made
    one = layer(spark, sf, "fx_boxes").filter("region_id = 'N07'")
    return coverage.coverage(G.edges(one, ["region_id"]), GRID)


@query("u1_u2_union_layers", "SELECT region_id, CAST(grp AS STRING) AS grp, CAST(NULL AS STRING) AS name, 'EPSG:4326' AS crs FROM fx_tiles UNION ALL SELECT CAST(NULL AS STRING), CAST(NULL AS STRING), name, 'EPSG:4326' FROM fx_codes")
def _(spark, sf):
    a, b = load(spark, sf, "fx_tiles").select("region_id", F.col("grp").cast("string")), load(spark, sf, "fx_codes").select("name")
    return harmonise.union_layers(a, b).withColumn("crs", F.lit("EPSG:4326"))


@query("a2_a10_dissolve_first", f"WITH {_CODES} SELECT iso3_code, min_by(id, num_id) AS id, min_by(ison_code, num_id) FILTER (ison_code IS NOT NULL) AS ison_code, count(*) AS parts FROM codes WHERE iso3_code IS NOT NULL GROUP BY iso3_code")
def _(spark, sf):
    c = codes(spark, sf).join(layer(spark, sf, "fx_tiles").withColumn("num_id", F.col("row_id") + 1).select("num_id", "geometry"), "num_id")
    d = layers.dissolve(c, "iso3_code", "num_id", ["id", "ison_code"])
    return d.select("iso3_code", "id", "ison_code", F.size("geometry").cast("bigint").alias("parts"))


@query("a4_merge_regions", """SELECT region_id, grp, row_id, CAST(1 AS BIGINT) AS parts FROM fx_tiles WHERE region_id NOT IN ('T03', 'T04', 'T09')
    UNION ALL SELECT 'TX', grp, row_id, CAST(1 AS BIGINT) FROM fx_tiles WHERE region_id = 'T04'""")
def _(spark, sf):
    m = layers.merge_regions(layer(spark, sf, "fx_tiles"), "region_id", ("T03", "T04", "T09"), "T04", {"region_id": "TX"})
    return m.select("region_id", "grp", "row_id", F.size("geometry").cast("bigint").alias("parts"))


@query("a2_dissolve_overlapping", f"SELECT grp, CAST(x // 8 AS INTEGER) AS col, CAST(15 - y // 8 AS INTEGER) AS row, CAST(count(*) AS DOUBLE) / 64 AS frac FROM ({_fine('fx_boxes', 'grp')}) GROUP BY ALL")
def _(spark, sf):
    own = layers.dissolve(layer(spark, sf, "fx_boxes"), "grp", "row_id", ["row_id"])
    return coverage.coverage(G.edges(own, ["grp"]), GRID, "grp")


_MERGED = "('N00', 'N05', 'N10', 'N11', 'N13', 'N24')"


@query("a4_merge_overlapping", f"SELECT region_id, CAST(x // 8 AS INTEGER) AS col, CAST(15 - y // 8 AS INTEGER) AS row, CAST(count(*) AS DOUBLE) / 64 AS frac FROM ({_fine(f"(SELECT CASE WHEN region_id IN {_MERGED} THEN 'NX' ELSE region_id END AS region_id, minx, miny, maxx, maxy FROM fx_boxes)", 'region_id')}) GROUP BY ALL")
def _(spark, sf):
    m = layers.merge_regions(layer(spark, sf, "fx_boxes"), "region_id", ("N00", "N05", "N10", "N11", "N13", "N24"), "N05", {"region_id": "NX"})
    return coverage.coverage(G.edges(m, ["region_id"]), GRID)


@query("a2_dissolve_polygons", _cell_parts(_fine("fx_boxes", "grp"), "grp"))
def _(spark, sf):
    return layers.dissolve(layer(spark, sf, "fx_boxes"), "grp", "row_id", []).select(*_shape("grp"))


@query("a4_merge_polygons", _cell_parts(_fine(f"(SELECT * FROM fx_boxes WHERE region_id IN {_MERGED})", "'NX' AS region_id"), "region_id"))
def _(spark, sf):
    m = layers.merge_regions(layer(spark, sf, "fx_boxes"), "region_id", ("N00", "N05", "N10", "N11", "N13", "N24"), "N05", {"region_id": "NX"})
    return m.filter("region_id = 'NX'").select(*_shape("region_id"))


@query("a2_dissolve_parcels", f"WITH RECURSIVE {_joined('SELECT grp, row_id AS i, minx, miny, maxx, maxy FROM fx_parcels', 'grp', 'p')}, c AS ({_fine('fx_parcels', 'grp')}), t AS (SELECT grp, CAST(count(*) AS DOUBLE) / 64 AS area FROM c GROUP BY grp) SELECT t.grp, count(DISTINCT part) AS parts, CASE WHEN count(DISTINCT part) > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, any_value(area) AS area FROM p_part JOIN t ON t.grp = p_part.grp GROUP BY t.grp")
def _(spark, sf):
    # grows with customer; dealt out, as few tasks read it
    own = G.from_boxes(load(spark, sf, "fx_parcels").repartition("row_id"))
    return layers.dissolve(own, "grp", "row_id", []).select(*_shape("grp")).select("grp", "parts", "kind", "area")


@query("g3_gap_polygons", _cell_parts(f"SELECT t.region_id, x, y FROM ({_fine('fx_tiles', 'region_id')}) t ANTI JOIN (SELECT DISTINCT x, y FROM ({_fine('fx_boxes', 'region_id')})) b USING (x, y)", "region_id"))
def _(spark, sf):
    return layers.gap_polygons(layer(spark, sf, "fx_tiles"), layer(spark, sf, "fx_boxes"), "region_id").select(*_shape("region_id"))


# a quarter of a degree west of the grid's zero; boxes that reach over the cut are in two places
_TURNED = """(SELECT region_id, greatest(minx - 12, -0.25) + 0.25 AS minx, miny, maxx - 12 + 0.25 AS maxx, maxy FROM fx_boxes WHERE maxx - 12 > -0.25
    UNION ALL SELECT region_id, minx - 12 + 360.25 AS minx, miny, least(maxx - 12, -0.25) + 360.25 AS maxx, maxy FROM fx_boxes WHERE minx - 12 < -0.25)"""


@query("mask_build", f"""WITH m AS (SELECT region_id, row, col, CAST(sum(frac) AS DOUBLE) AS frac FROM ({_cov(_TURNED).replace('x < 32', 'x < 360')}) GROUP BY ALL)
    SELECT region_id, row, col, frac / sum(frac) OVER (PARTITION BY row, col) AS frac FROM m""")
def _(spark, sf):
    b = load(spark, sf, "fx_boxes").withColumns({"minx": F.col("minx") - 12, "maxx": F.col("maxx") - 12})
    return build.mask(G.from_boxes(b), Grid(-0.25, 0, 359.75, 16, 1)).select("region_id", "row", "col", "frac")


@query("a5_total_bounds", "SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM fx_parcels")
def _(spark, sf):
    e = G.edges(layer(spark, sf, "fx_parcels"), ["region_id"])
    return e.agg(F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x0").alias("maxx"), F.max("y0").alias("maxy"))


_RULES = (
    layers.SplitRule("0", "south", ((3, 7, 0, 0),), {"NAME": "South"}),
    layers.SplitRule("0", "0", ((0, 8, 30, 15),)),
    layers.SplitRule("1", "inner", ((8, 4, 9, 5), (25, 13, 26, 14)), {"NAME": "Inner"}),
    layers.SplitRule("2", "2", ((-5, -5, 40, 40),), {}, ((11, -1, 19, 5.5),)),
)
_T = "(SELECT *, CAST(grp AS STRING) AS g FROM fx_tiles)"
_HIT = lambda b: f"(minx <= {max(b[0], b[2])} AND {min(b[0], b[2])} <= maxx AND miny <= {max(b[1], b[3])} AND {min(b[1], b[3])} <= maxy)"


def _rule_sql(r: layers.SplitRule) -> str:
    hit = " OR ".join(map(_HIT, r.boxes))
    out = " AND ".join(f"(minx > {b[0]} AND miny > {b[1]} AND maxx < {b[2]} AND maxy < {b[3]})" for b in r.minus) or "false"
    return f"SELECT '{r.new_id}' AS ID, count(*) AS parts FROM (SELECT part FROM t JOIN t_part p ON p.i = t.row_id WHERE t.g = '{r.source}' GROUP BY part HAVING bool_or({hit}) AND NOT bool_and({out})) HAVING count(*) > 0"


@query("split_countries", f"WITH RECURSIVE t AS {_T}, {_joined('SELECT grp, row_id AS i, minx, miny, maxx, maxy FROM fx_tiles', 'grp', 't')} " + " UNION ALL ".join(map(_rule_sql, _RULES)) + " UNION ALL SELECT CAST(grp AS STRING), count(DISTINCT part) FROM t_part WHERE grp NOT IN (0, 2) GROUP BY grp")
def _(spark, sf):
    t = layers.dissolve(layer(spark, sf, "fx_tiles").withColumn("ID", F.col("grp").cast("string")), "ID", "row_id", ["row_id"]).withColumn("NAME", F.col("ID"))
    s = layers.split_countries(t.select("ID", "NAME", "geometry"), _RULES)
    return s.select("ID", F.size("geometry").cast("bigint").alias("parts"))


@query("sea_grouping_cut", "SELECT region_id, parent, minx, maxx FROM (SELECT region_id, 'Indian' AS parent, minx, least(maxx, 16.5) AS maxx FROM fx_boxes WHERE region_id = 'N03' UNION ALL SELECT region_id, 'Pacific', greatest(minx, 16.5), maxx FROM fx_boxes WHERE region_id = 'N03' AND maxx > 16.5 UNION ALL SELECT region_id, 'Indian', minx, maxx FROM fx_boxes WHERE region_id <> 'N03')")
def _(spark, sf):
    t = layer(spark, sf, "fx_boxes").select("region_id", F.lit("Indian").alias("parent"), "geometry")
    cut = layers.cut_at_meridian(t, "region_id", "N03", 16.5, "parent", "Pacific")
    return cut.select("region_id", "parent", G.bounds("geometry").alias("b")).select("region_id", "parent", "b.minx", "b.maxx")


_OCEAN = ((0, 0.0, 0.0, 14.0, 8.0), (1, 15.0, 0.0, 29.0, 8.5), (2, 2.0, 9.0, 30.0, 15.0), (3, 33.0, 2.0, 34.0, 3.0))
_MERC = lambda v: f"6378137.0 * asinh(tan(radians({v})))"
_DISTANCE = f"""sqrt(pow(6378137.0 * radians(greatest(g.a / 8 - s.maxx, s.minx - (g.b + 1) / 8, 0)), 2)
    + pow(greatest({_MERC('g.y / 8')} - {_MERC('s.maxy')}, {_MERC('s.miny')} - {_MERC('(g.y + 1) / 8')}, 0), 2))"""
# every sea has its group for a parent; N03 is cut at 16.5; gaps of the ocean go to the nearest seas
_SEAS = f"""o AS ({" UNION ALL ".join(f"SELECT {a} AS minx, {b} AS miny, {c} AS maxx, {d} AS maxy, {i} AS ocean" for i, a, b, c, d in _OCEAN)}),
    s0 AS (SELECT region_id, 'Sea ' || CAST(grp AS STRING) AS parent_reg, minx, miny, CASE WHEN region_id = 'N03' THEN least(maxx, 16.5) ELSE maxx END AS maxx, maxy FROM fx_boxes
        UNION ALL SELECT region_id, 'Far Sea', 16.5, miny, maxx, maxy FROM fx_boxes WHERE region_id = 'N03' AND maxx > 16.5),
    s AS (SELECT *, row_number() OVER (ORDER BY region_id, minx) AS sea FROM s0),
    ow AS ({_fine("o", "ocean")}), sw AS ({_fine("s", "parent_reg")}), gw AS (SELECT * FROM ow ANTI JOIN sw USING (x, y)),
    grun AS (SELECT ocean, y, min(x) AS a, max(x) AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY ocean, y ORDER BY x) AS k FROM gw) GROUP BY ocean, y, k),
    gn AS (SELECT *, row_number() OVER (ORDER BY ocean, y, a) AS i FROM grun),
    ge AS (SELECT p.i AS u, q.i AS v FROM gn p JOIN gn q ON p.ocean = q.ocean AND abs(p.y - q.y) = 1 AND p.a <= q.b AND q.a <= p.b),
    gr AS (SELECT i, i AS l FROM gn UNION SELECT v, l FROM gr JOIN ge ON u = i WHERE l < v),
    gap AS (SELECT i, min(l) AS gap FROM gr GROUP BY i),
    gd AS (SELECT gap, parent_reg, sea, min({_DISTANCE}) AS d FROM gap JOIN gn g USING (i), s GROUP BY gap, parent_reg, sea),
    gp AS (SELECT DISTINCT gap, parent_reg FROM (SELECT *, rank() OVER (PARTITION BY gap ORDER BY round(d, 6)) AS k FROM gd) WHERE k = 1),"""
_SEA_CELLS = """SELECT DISTINCT parent_reg, x, y FROM sw JOIN (SELECT DISTINCT x, y FROM ow) USING (x, y)
    UNION SELECT parent_reg, x, y FROM gp JOIN gap USING (gap) JOIN gn USING (i), unnest(range(gn.a, gn.b + 1)) AS t(x)"""


@query("sea_layer", _cell_parts(_SEA_CELLS, "parent_reg", _SEAS))
def _(spark, sf):
    t = layer(spark, sf, "fx_boxes")
    seas = t.select(F.when(F.col("row_id") % 2 == 0, F.col("region_id")).alias("name"), F.col("region_id").alias("note"), "geometry")
    names = t.select(F.upper("region_id").alias("sea"), F.concat(F.lit("Sea "), F.col("grp").cast("string")).alias("parent"))
    ocean = G.from_boxes(spark.createDataFrame([b[1:] for b in _OCEAN], "minx double, miny double, maxx double, maxy double"))
    return layers.sea_regions(seas, ocean, names, ("N03", "N03 EAST", "Far Sea"), 16.5).select(*_shape("parent_reg"))


@query("country_layer", """SELECT id AS ID, name AS NAME, iso AS ISO3_CODE, num AS NUM_ID, parts, area FROM (
    SELECT CASE WHEN k = 0 THEN 'NO' WHEN k = 1 THEN 'FR' ELSE 'Z' || lpad(CAST(k AS STRING), 2, '0') END AS id, CASE WHEN k = 0 THEN 'Norway' WHEN k = 1 THEN 'France' ELSE n_name END AS name,
        CASE WHEN k = 0 THEN 'NOR' WHEN k = 1 THEN 'FRA' WHEN k % 3 <> 0 THEN 'Z' || lpad(CAST(k AS STRING), 2, '0') END AS iso, k + 1 AS num, CAST(1 AS BIGINT) AS parts, CAST(3 AS DOUBLE) AS area
    FROM (SELECT *, CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k NOT IN (2, 3, 4)
    UNION ALL SELECT 'SJ', 'Svalbard and Jan Mayen', 'SJM', 101, 1, 2 UNION ALL SELECT 'YT', 'Mayotte', 'MYT', 102, 1, 0.375
    UNION ALL SELECT 'CX', 'Christmas Island', 'CXR', 103, 1, 0.25 UNION ALL SELECT 'CC', 'Cocos (Keeling) Islands', 'CCK', 104, 1, 0.5
    UNION ALL SELECT 'EWSB', 'Cyprus U.K. Bases', NULL, 105, 1, 5)""")
def _(spark, sf):
    # -99 codes, a source that is split whole, two rows that are merged, the rest as it is
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("bigint"))
    part = lambda *b: G.box(*[F.lit(float(v)) for v in b])
    own = G.box(F.col("k").cast("double"), F.lit(58.0), F.col("k") + 1.0, F.lit(61.0))
    place = {0: F.concat(part(6, 58, 7, 61), part(15, 76, 17, 77)), 1: F.concat(part(1, 45, 2, 48), part(44.5, -13.25, 45.25, -12.75)), 2: F.concat(part(105.25, -10.75, 105.75, -10.25), part(96.5, -12.5, 97.5, -12)), 3: part(32, 34, 33, 37), 4: part(33, 34, 34, 36)}
    name = {0: "Norway", 1: "France", 2: "Indian Ocean Territories", 3: "Akrotiri", 4: "Dhekelia"}
    pick = lambda d, other: F.coalesce(*[F.when(F.col("k") == k, v if not isinstance(v, str) else F.lit(v)) for k, v in d.items()], other)
    code = F.when((F.col("k") < 5) | (F.col("k") % 3 == 0), "-99").otherwise(F.concat(F.lit("Z"), F.lpad(F.col("k").cast("string"), 2, "0")))
    t = n.select(pick(name, F.col("n_name")).alias("NAME_LONG"), code.alias("ISO_A3"), F.lit("-99").alias("ISO_A2"), F.lit("-99").alias("ISO_N3"), (F.col("k") + 1000).alias("NE_ID"), pick(place, own).alias("geometry"))
    ids = pick({0: "NO", 1: "FR"}, F.concat(F.lit("Z"), F.lpad(F.col("k").cast("string"), 2, "0")))
    table = n.select(ids.alias("ID"), (F.col("k") + 1000).cast("string").alias("NE_ID"), pick({0: "NOR", 1: "FRA"}, ids).alias("ISO3_CODE"), (F.col("k") + 1).cast("string").alias("NUM_ID"))
    more = spark.createDataFrame([("SJ", "SJM", "101"), ("YT", "MYT", "102"), ("CX", "CXR", "103"), ("CC", "CCK", "104"), ("EWSB", None, "105")], "ID string, ISO3_CODE string, NUM_ID string")
    codes_of = table.unionByName(more, allowMissingColumns=True).withColumns({"ISO2_CODE": F.lit(None).cast("string"), "ISON_CODE": F.lit(None).cast("string"), "NAME": F.col("ID")})
    out = build.countries(t, codes_of)
    return out.select("ID", "NAME", "ISO3_CODE", "NUM_ID", F.size("geometry").cast("bigint").alias("parts"), G.area("geometry").alias("area"))


@query("s4_j8_stored_mask", f"SELECT 'region' AS asked, region_id, row, col, frac FROM ({_cov('fx_parcels')}) WHERE region_id = 'C42' UNION ALL SELECT 'box', region_id, row, col, frac FROM ({_cov('fx_parcels')}) WHERE row BETWEEN 3 AND 6 AND col BETWEEN 10 AND 13")
def _(spark, sf):
    path = f"{scratch.folder(spark)}/mask-{uuid.uuid4().hex}"
    tables.write_mask(mask_of(spark, sf, "fx_parcels"), load(spark, sf, "fx_parcels").select("region_id", "grp"), GRID, path)
    one, box = tables.read_mask(spark, path, "C42"), tables.read_mask(spark, path, cells=(3, 6, 10, 13))
    return one.select(F.lit("region").alias("asked"), "*").unionByName(box.select(F.lit("box").alias("asked"), "*")).withColumn("frac", F.col("frac").cast("double"))


@query("k2_array_round_trip", f"SELECT region_id, row, col, frac FROM ({_cov('fx_parcels')})")
def _(spark, sf):
    path = f"{scratch.folder(spark)}/array-{uuid.uuid4().hex}"
    t = layer(spark, sf, "fx_parcels")
    arrays.write_array(mask_of(spark, sf, "fx_parcels"), t, GRID, path, normalised=False, chunk=(64, 16, 16))
    return arrays.read_array(spark, path).withColumn("frac", F.col("frac").cast("double"))


@query("d11_metadata_json", "SELECT region_id, CAST(json_object('region_id', region_id, 'grp', grp, 'row_id', row_id) AS STRING) AS metadata FROM fx_boxes")
def _(spark, sf):
    return tables.metadata(layer(spark, sf, "fx_boxes").select("region_id", "grp", "row_id", "geometry"))


@query("d11_metadata_round_trip", "SELECT region_id, grp FROM fx_tiles")
def _(spark, sf):
    one = tables.metadata_list(layer(spark, sf, "fx_tiles").select("region_id", "grp", "row_id", "geometry"), "row_id")
    back = F.from_json("metadata", "array<struct<region_id:string,grp:bigint,row_id:bigint>>")
    return one.select(F.explode(back).alias("r")).select("r.region_id", "r.grp")


_PAIRS = " || ',' || ".join(f"'[' || CAST({x} AS STRING) || ',' || CAST({y} AS STRING) || ']'" for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")))


@query("k1_geojson_features", f"""SELECT '{{"type":"Feature","properties":{{"region_id":"' || region_id || '","grp":' || CAST(grp AS STRING) || '}},"geometry":{{"type":"MultiPolygon","coordinates":[[[' || {_PAIRS} || ']]]}}}}' AS value FROM fx_boxes""")
def _(spark, sf):
    return tables.geojson(layer(spark, sf, "fx_boxes").select("region_id", "grp", "geometry"))


# -------------------------------------------------------------------------------------- extensions
@query("x_regional_mean", f"""WITH m AS ({_cov('fx_tiles')}), o AS (SELECT CAST(floor(16 - lat) AS INTEGER) AS row, CAST(floor(lon) AS INTEGER) AS col, CAST(floor(value) AS DOUBLE) AS v FROM fx_obs)
    SELECT region_id, sum(frac) AS weight, sum(v * frac) / sum(frac) AS mean FROM o JOIN m ON o.row = m.row AND o.col = m.col GROUP BY region_id""")
def _(spark, sf):
    obs = load(spark, sf, "fx_obs").withColumn("v", F.floor("value").cast("double"))
    return coverage.regional_mean(mask_of(spark, sf, "fx_tiles"), coverage.to_cells(obs, GRID).select("row", "col", "v"), "v")
