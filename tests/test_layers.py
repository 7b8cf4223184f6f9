"""Harmonisation, joins, sources and error paths."""

import random

import pytest
from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import boolean, harmonise, layers, predicates
from cellshare.plans.config import MaskConfig, read_env, truth
from cellshare.plans.grid import Grid
from cellshare.sources import shapefile, tables

BOX = "id string, minx double, miny double, maxx double, maxy double"


def boxes(spark, rows):
    return G.from_boxes(spark.createDataFrame(rows, BOX))


def test_nearest_keeps_ties(spark):
    gap = boxes(spark, [("g", 4.0, 0.0, 5.0, 1.0)]).select(F.col("id").alias("gap"), "geometry")
    sea = boxes(spark, [("a", 0.0, 0.0, 3.0, 1.0), ("b", 6.0, 0.0, 9.0, 1.0), ("c", 20.0, 0.0, 21.0, 1.0)]).select(F.col("id").alias("sea"), "geometry")
    assert {(r.sea, r.distance) for r in predicates.nearest(gap, sea, "gap", "sea", project=False).collect()} == {("a", 1.0), ("b", 1.0)}
    assert len(predicates.nearest(gap, sea, "gap", "sea").collect()) == 2


def test_nearest_ties_to_the_micrometre(spark):
    """In Mercator metres both are a degree away but for the last digit."""
    gap = boxes(spark, [("g", 5.0, 0.0, 6.0, 1.0)]).select(F.col("id").alias("gap"), "geometry")
    sea = boxes(spark, [("a", 3.0, 0.0, 4.0, 1.0), ("b", 7.0, 0.0, 8.0, 1.0), ("c", 7.001, 0.0, 8.0, 1.0)]).select(F.col("id").alias("sea"), "geometry")
    assert {r.sea for r in predicates.nearest(gap, sea, "gap", "sea").collect()} == {"a", "b"}


def test_nearest_near_and_far(spark):
    """Against all pairs; some regions are far from everything, some are wide, and one layer may be empty."""
    import random

    rng = random.Random(5)
    make = lambda n, wide: [(k, x := rng.choice([rng.uniform(0, 10), rng.uniform(0, 900)]), y := rng.uniform(0, 10), x + rng.choice([0.5, wide]), y + 0.5) for k in range(n)]
    a, b = make(40, 30.0), make(30, 5.0)
    layer = lambda rows, i: G.from_boxes(spark.createDataFrame(rows, f"{i} int, minx double, miny double, maxx double, maxy double")).select(i, "geometry")
    gap = lambda p, q: (max(p[1] - q[3], q[1] - p[3], 0) ** 2 + max(p[2] - q[4], q[2] - p[4], 0) ** 2) ** 0.5
    got = {}
    for r in predicates.nearest(layer(a, "p"), layer(b, "q"), "p", "q", project=False).collect():
        got.setdefault(r.p, {})[r.q] = r.distance
    for p in a:
        least = min(gap(p, q) for q in b)
        assert got[p[0]].keys() == {q[0] for q in b if gap(p, q) == least}
        assert all(abs(d - least) < 1e-9 for d in got[p[0]].values())
    assert predicates.nearest(layer(a, "p"), layer(b, "q").limit(0), "p", "q").count() == 0


def _clip(points, a, b):
    out, side = [], lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        if side(p) >= 0:
            out.append(p)
        if side(p) * side(q) < 0:
            t = side(p) / (side(p) - side(q))
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def _area(points):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2


def _common(p, c, q, d):
    """Area of two star polygons' intersection: of all pairs of triangles around their centres."""
    total = 0.0
    for a, b in zip(p, p[1:] + p[:1], strict=True):
        for e, f in zip(q, q[1:] + q[:1], strict=True):
            w, corners = [c, a, b], [d, e, f]
            for i in range(3):
                w = _clip(w, corners[i], corners[(i + 1) % 3]) if w else w
            total += _area(w) if len(w) > 2 else 0.0
    return total


@pytest.mark.parametrize("cell", [None, 0.5])
def test_overlay_of_star_polygons(spark, cell):
    import math
    import random

    from cellshare.operators import boolean, rings

    rng, rows, want = random.Random(1), ([], []), {}
    for k in range(4):
        centres = [(rng.uniform(-10, 10), rng.uniform(-10, 10))]
        centres.append((centres[0][0] + rng.uniform(-2, 2), centres[0][1] + rng.uniform(-2, 2)))
        stars = []
        for (x, y), into in zip(centres, rows, strict=True):
            n, size = rng.randrange(5, 30), rng.uniform(2, 9)
            radii = [size * rng.uniform(0.3, 1) for _ in range(n)]
            stars.append([(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(radii)])
            into += [(k, *map(float, (*a, *b))) for a, b in zip(stars[-1], stars[-1][1:] + stars[-1][:1], strict=True)]
        both = _common(stars[0], centres[0], stars[1], centres[1])
        want[k] = {"intersection": both, "difference": _area(stars[0]) - both, "union": _area(stars[0]) + _area(stars[1]) - both}
    a, b = (spark.createDataFrame(r, "k int, x0 double, y0 double, x1 double, y1 double") for r in rows)
    for how in ("intersection", "difference", "union"):
        got = {r.k: r.a for r in boolean.overlay(a, b, how, ["k"], cell).groupBy("k").agg(G.bag_area().alias("a")).collect()}
        assert all(abs(got.get(k, 0.0) - want[k][how]) < 1e-6 for k in want)
    # the union again, as polygons
    parts = rings.polygons(boolean.overlay(a.unionByName(b), None, "union", ["k"], cell), ["k"], cell).select("k", G.area("geometry").alias("a"))
    assert all(abs(r.a - want[r.k]["union"]) < 1e-6 for r in parts.collect())


def test_dissolve_is_a_union(spark):
    t = boxes(spark, [("a", 0.0, 0.0, 2.0, 1.0), ("a", 1.0, 0.0, 3.0, 1.0), ("a", 5.0, 0.0, 6.0, 1.0), ("b", 0.0, 0.0, 1.0, 1.0), ("c", 0.0, 0.0, 1.0, 1.0)]).withColumn("row_id", F.monotonically_increasing_id())
    t = t.withColumn("geometry", F.when(F.col("id") != "c", F.col("geometry")))
    got = {r.id: r.a for r in layers.dissolve(t, "id").select("id", G.area("geometry").alias("a")).collect()}
    assert got == {"a": 4.0, "b": 1.0, "c": None}
    merged = layers.merge_regions(t.filter("id <> 'c'"), "id", ("a", "b"), "b")
    assert [(r.id, r.a) for r in merged.select("id", G.area("geometry").alias("a")).collect()] == [("b", 4.0)]


def test_boxes_that_meet_another(spark, monkeypatch):
    """Against all pairs, for boxes of many sizes; where they lie over each other few are compared with all."""
    rng, rows = random.Random(5), []
    for k in range(600):
        w = rng.choice([0.0, 0.03, 1.0, 1.0, 40.0 if k % 50 == 0 else 0.5])
        x, y = rng.uniform(-180, 180 - w), rng.uniform(-90, 90 - w)
        rows.append((k % 3, k, (x, y, x + w, y + w * rng.random())))
    kind = "grp int, _id long, _b struct<minx:double,miny:double,maxx:double,maxy:double>"
    meet = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    want = {(g, i) for g, i, b in rows if any(g == h and i != j and meet(b, c) for h, j, c in rows)}
    got = [tuple(r) for r in predicates.meeting_boxes(spark.createDataFrame(rows, kind), ["grp"]).collect()]
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < 600
    sizes, settle = [], predicates.settle
    monkeypatch.setattr(predicates, "settle", lambda df: sizes.append(settle(df)) or sizes[-1])
    crowd = [(0, k, (x, y, x + 1, y + 1)) for k in range(4000) for x, y in [(rng.uniform(0, 16), rng.uniform(0, 8))]]
    assert predicates.meeting_boxes(spark.createDataFrame(crowd, kind), ["grp"]).count() == 4000
    assert sizes[-1].count() < 200


def test_copies_dissolve_to_one(spark):
    box = lambda a, b, c, d: [[[(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d)), (float(a), float(b))]]]
    rows = [("a", k, box(0, 0, 2, 2)) for k in range(20)] + [("a", 20, box(5, 5, 6, 6)), ("a", 21, box(3, 3, 4, 4) + box(8, 8, 9, 9)), ("b", 22, box(0, 0, 1, 1))]
    got = {r.grp: r.geometry for r in layers.dissolve(spark.createDataFrame(rows, f"grp string, row_id long, geometry {G.GEOMETRY}"), "grp", "row_id", []).collect()}
    corners = [(min(p.x for p in part[0]), max(p.x for p in part[0])) for part in got["a"]]
    assert corners == [(5.0, 6.0), (3.0, 4.0), (8.0, 9.0), (0.0, 2.0)] and len(got["b"]) == 1


def test_crowded_edges_get_smaller_cells(spark):
    rows = [("a", [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]]) for k in range(3000) for x, y in [(k % 80 / 8.0, k // 80 / 8.0)]]
    e = G.edges(spark.createDataFrame(rows, f"grp string, geometry {G.GEOMETRY}"), ["grp"])
    few = e.filter("x0 < 0.125 and y0 < 0.125")
    assert boolean.crowded_size(e, ["grp"]) < boolean.cell_size(e) and boolean.crowded_size(few, ["grp"]) == boolean.cell_size(few)
    assert round(boolean.repair(e, ["grp"]).agg(G.bag_area()).collect()[0][0], 6) == 60.546875


def test_seas_over_many_strips(spark, monkeypatch):
    """Pieces of water, level sides and slanted ones, over strips of the union that only their level sides meet."""
    flat = boxes(spark, [("a", 0.0, 0.0, 40.0, 1.0), ("b", 0.0, 1.0, 40.0, 2.0), ("c", 0.0, 2.0, 40.0, 3.0)]).select("id", "geometry")
    slope = [[[(0.0, 10.0), (9.0, 12.0), (9.0, 14.0), (0.0, 14.0), (0.0, 10.0)]]]
    seas = flat.unionByName(spark.createDataFrame([("d", slope)], f"id string, geometry {G.GEOMETRY}")).select(F.col("id").alias("name"), F.lit("").alias("note"), "geometry")
    ocean = boxes(spark, [("o", -1.0, 0.0, 40.0, 2.5), ("p", 50.0, 0.0, 51.0, 1.0), ("q", 1.0, 9.0, 8.0, 13.0)]).select("geometry")
    names = spark.createDataFrame([("A", "P"), ("B", "P"), ("C", "Q"), ("D", "R")], "sea string, parent string")
    # a gap along a, b and c, one near a alone, one beside d
    want = {"P": (2, 83.5), "Q": (1, 22.5), "R": (1, 28.0)}
    monkeypatch.setattr(boolean, "crowded_size", lambda *_: 2.0)
    out = layers.sea_regions(seas, ocean, names, ("none", "none", "none"), 0.0, project=False)
    assert {r.parent_reg: (r.n, round(r.a, 6)) for r in out.select("parent_reg", F.size("geometry").alias("n"), G.area("geometry").alias("a")).collect()} == want


def test_mask_from_settings_to_file(spark, tmp_path):
    """Settings, shapefile, repair, turn of longitude, coverage, normalisation, mask; overlapping parts count once."""
    from cellshare.plans import build

    twice = F.array(G.box(F.lit(-2.0), F.lit(0.0), F.lit(-1.0), F.lit(1.0))[0], G.box(F.lit(-1.5), F.lit(0.0), F.lit(0.5), F.lit(1.0))[0])
    t = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "ID string, N bigint")
    t = t.withColumn("geometry", F.when(F.col("N") == 1, twice).when(F.col("N") == 2, G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
    shapefile.write_shapefile(t, str(tmp_path / "l.shp"))
    env = {"MASK_SHAPE_FILE_PATH": str(tmp_path / "l.shp"), "MASK_FILE_PATH": str(tmp_path / "m"), "MASK_RESOLUTION": "1", "MASK_MIN_LON": "0", "MASK_MAX_LON": "360", "MASK_MIN_LAT": "0", "MASK_MAX_LAT": "1"}
    got = {(r.ID, r.col): round(r.frac, 6) for r in build.run(spark, MaskConfig.from_env(env)).collect()}
    assert got == {("A", 358): 1.0, ("A", 359): 1.0, ("A", 0): round(0.5 / 1.5, 6), ("B", 0): round(1 / 1.5, 6)}
    assert spark.read.parquet(str(tmp_path / "m" / "metadata")).count() == 3


def test_country_layer(spark):
    from cellshare.plans import build

    two = F.array(G.box(F.lit(5.0), F.lit(60.0), F.lit(10.0), F.lit(65.0))[0], G.box(F.lit(12.0), F.lit(76.0), F.lit(20.0), F.lit(80.0))[0])
    t = spark.createDataFrame([("Norway", "NOR", "NO", "578", 11), ("Akrotiri Sovereign Base Area", "-99", "-99", "-99", 12), ("Dhekelia Sovereign Base Area", "-99", "-99", "-99", 13)], "NAME_LONG string, ISO_A3 string, ISO_A2 string, ISO_N3 string, NE_ID bigint")
    t = t.withColumn("geometry", F.when(F.col("NE_ID") == 11, two).otherwise(G.box(F.col("NE_ID").cast("double"), F.lit(30.0), F.col("NE_ID") + 1.5, F.lit(31.0))))
    codes = spark.createDataFrame([("NO", "Norway", "11", "NOR", "NO", "578", "7"), ("SJ", "Svalbard", None, "SJM", "SJ", "744", "8"), ("EWSB", "Bases", None, None, None, None, "9")], "ID string, NAME string, NE_ID string, ISO3_CODE string, ISO2_CODE string, ISON_CODE string, NUM_ID string")
    got = {r.ID: (r.NAME, r.ISO3_CODE, r.ISON_CODE, r.NUM_ID, round(r.a, 6)) for r in build.countries(t, codes).withColumn("a", G.area("geometry")).collect()}
    assert got == {"NO": ("Norway", "NOR", "578", 7, 25.0), "SJ": ("Svalbard and Jan Mayen", "SJM", "744", 8, 32.0), "EWSB": ("Cyprus U.K. Bases", None, None, 9, 2.5)}


def test_touching_counts_contact_and_containment(spark):
    parts = boxes(spark, [("edge", 0.0, 0.0, 1.0, 1.0), ("around", -9.0, -9.0, 9.0, 9.0), ("off", 3.5, 3.5, 4.0, 4.0)]).select("id", "geometry")
    box = spark.createDataFrame([(1, 3.0, 3.0, 1.0, 1.0)], "box_id int, minx double, miny double, maxx double, maxy double")
    assert {r.id for r in predicates.touching(parts, box, ["id"]).collect()} == {"edge", "around"}


def test_split_modes(spark):
    two = F.array(G.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))[0], G.box(F.lit(5.0), F.lit(0.0), F.lit(6.0), F.lit(1.0))[0], G.box(F.lit(9.0), F.lit(0.0), F.lit(9.5), F.lit(1.0))[0])
    t = spark.createDataFrame([("S", "Src")], "ID string, NAME string").select("ID", "NAME", two.alias("geometry"))
    rules = (
        layers.SplitRule("Src", "N", ((4, 0, 7, 1),), {"NAME": "New"}),
        layers.SplitRule("Src", "S", ((-1, -1, 7, 2),)),
        layers.SplitRule("Src", "Z", ((50, 50, 51, 51),), {"NAME": "Nothing"}),
        layers.SplitRule("Missing", "M", ((0, 0, 1, 1),), {"NAME": "Gone"}),
    )
    out = {r.ID: (r.NAME, len(r.geometry)) for r in layers.split_countries(t, rules).collect()}
    # the part in both rules is in both regions, the part in none is gone
    assert out == {"S": ("Src", 2), "N": ("New", 1)}


def test_merge_without_match_raises(spark):
    with pytest.raises(ValueError):
        layers.merge_regions(boxes(spark, [("a", 0.0, 0.0, 1.0, 1.0)]).withColumn("row_id", F.lit(1)), "id", ("zz",))


def test_lookup_needs_unique_keys(spark):
    codes = spark.createDataFrame([("USA", "US", 1), ("USA", "AK", 2)], "k string, v string, n int")
    t = spark.createDataFrame([("USA",), (None,), ("XXX",)], "c string")
    with pytest.raises(ValueError):
        harmonise.lookup(t, codes, "c", "k", "v", "o")
    assert {(r.c, r.o) for r in harmonise.lookup(t, codes, "c", "k", "v", "o", order="n").collect()} == {("USA", "US"), (None, None), ("XXX", None)}


def test_sea_ids(spark):
    names = ["South China and Easter Archipelagic Seas", "Southern Ocean", "  Baltic   Sea "]
    got = [r.i for r in spark.createDataFrame([(n,) for n in names], "n string").select(harmonise.sea_id(F.col("n")).alias("i")).collect()]
    assert got == ["OC_SCS", "OC_SO", "OC_BS"]


def test_crs_guard():
    with pytest.raises(ValueError):
        harmonise.same_crs("EPSG:4326", "EPSG:3857")
    assert not harmonise.same_crs("EPSG:4326", "EPSG:3857", strict=False)


def test_config(tmp_path):
    with pytest.raises(ValueError):
        read_env(tmp_path / "absent")
    f = tmp_path / "env"
    f.write_text("# c\nMASK_SHAPE_FILE_PATH='a.shp'\nMASK_FILE_PATH=m\nMASK_RESOLUTION=0.5\nNORMALIZE_MASK=No\n")
    c = MaskConfig.from_env(read_env(f))
    assert (c.grid.width, c.grid.height, c.normalise) == (720, 360, False)
    with pytest.raises(ValueError):
        MaskConfig.from_env({"MASK_FILE_PATH": "m"})
    assert truth("YES") and truth("1") and not truth("on")


def test_codes_keep_namibia(spark, tmp_path):
    f = tmp_path / "codes.csv"
    f.write_text("ID;NAME;NE_ID\nNA;Namibia;1.0\nXX;\"Bonaire; Saba\";N/A\nYY;;\n", encoding="utf-8")
    got = [tuple(r) for r in tables.read_codes(spark, str(f)).collect()]
    assert got == [("NA", "Namibia", "1.0"), ("XX", "Bonaire; Saba", None), ("YY", None, None)]


def test_shapefile_round_trip(spark, tmp_path):
    hole = F.array(F.array(G.box(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(3.0))[0][0], F.reverse(G.box(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))[0][0])), G.box(F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(6.0))[0])
    t = spark.createDataFrame([("é", 7, 1.5), (None, None, None)], "ID string, N bigint, D double").withColumn("geometry", F.when(F.col("N") == 7, hole))
    path = str(tmp_path / "layer.shp")
    shapefile.write_shapefile(t, path, "GEOGCS[]")
    back = shapefile.read_shapefile(spark, path, 2)
    rows = {r.ID: r for r in back.withColumn("a", G.area("geometry")).collect()}
    assert (rows["é"].N, rows["é"].D, rows["é"].a, len(rows["é"].geometry)) == (7, 1.5, 9.0, 2)
    assert rows[None].geometry is None and rows[None].N is None
    assert shapefile.crs(path) == "GEOGCS[]"


def test_shapefile_kinds(spark, tmp_path):
    """Polygons with heights or measures are read like plain ones; other kinds raise."""
    import struct

    t = boxes(spark, [("a", 0.0, 0.0, 2.0, 1.0)]).select("id", "geometry")
    path = tmp_path / "layer.shp"
    shapefile.write_shapefile(t, str(path))
    raw = bytearray(path.read_bytes())
    for kind in (15, 25):
        raw[108:112] = struct.pack("<i", kind)
        path.write_bytes(raw)
        assert [r.a for r in shapefile.read_shapefile(spark, str(path), 1).select(G.area("geometry").alias("a")).collect()] == [2.0]
    raw[108:112] = struct.pack("<i", 3)
    path.write_bytes(raw)
    with pytest.raises(Exception, match="kind 3"):
        shapefile.read_shapefile(spark, str(path), 1).collect()


def test_mask_round_trip(spark, tmp_path):
    from cellshare.operators import coverage

    layer = boxes(spark, [("a", 0.0, 0.0, 1.5, 1.0), ("b", 1.5, 0.0, 2.0, 1.0)]).withColumnRenamed("id", "region_id")
    grid = Grid(0, 0, 2, 1, 1)
    mask = coverage.coverage(G.edges(layer, ["region_id"]), grid)
    tables.write_mask(mask, layer, grid, str(tmp_path / "m"))
    assert {(r.col, r.frac) for r in tables.read_mask(spark, str(tmp_path / "m"), "a").collect()} == {(0, 1.0), (1, 0.5)}
    with pytest.raises(KeyError):
        tables.read_mask(spark, str(tmp_path / "m"), "zz")
    attrs = spark.read.parquet(str(tmp_path / "m" / "attributes")).collect()[0]
    assert (attrs.crs, attrs.resolution, list(attrs.transform)) == ("EPSG:4326", 1.0, [1.0, 0.0, 0.0, 0.0, -1.0, 1.0])


def test_layer_round_trip_skips_by_box(spark, tmp_path):
    tables.write_layer(boxes(spark, [("a", 0.0, 0.0, 1.0, 1.0), ("b", 8.0, 8.0, 9.0, 9.0)]), str(tmp_path / "l"))
    assert [r.id for r in tables.read_layer(spark, str(tmp_path / "l"), (7, 7, 10, 10)).collect()] == ["b"]


def test_stream_joins_the_mask(spark, tmp_path):
    from cellshare.streaming.observations import regional_stream

    rows = [("2024-01-01 00:10:00", 0.5, 0.5, 2.0), ("2024-01-01 00:20:00", 0.5, 0.5, 4.0), ("2024-01-01 05:00:00", 0.5, 0.5, 9.0)]
    spark.createDataFrame(rows, "ts string, lon double, lat double, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    mask = spark.createDataFrame([("r", 0, 0, 0.5)], "region_id string, row int, col int, frac double")
    stream = spark.readStream.schema("ts timestamp, lon double, lat double, value double").parquet(str(tmp_path / "in"))
    q = regional_stream(stream, mask, Grid(0, 0, 1, 1, 1)).writeStream.format("memory").queryName("regional").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.region_id, r.weight, r.mean) for r in spark.sql("select * from regional").collect()] == [("r", 1.0, 3.0)]
