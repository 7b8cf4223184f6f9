"""Region layers: splitting detached territories, merging, dissolving, grouping seas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import settle
from . import boolean, harmonise, predicates, rings

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class SplitRule:
    """Parts of ``source`` that touch a box become region ``new_id``, or its main part if the ids agree.

    ``minus``: boxes taken out of ``boxes``; a part wholly inside them isn't touched.
    """

    source: str
    new_id: str
    boxes: tuple[Box, ...]
    attributes: Mapping[str, str] = field(default_factory=dict)
    minus: tuple[Box, ...] = ()

    @property
    def mainland(self) -> bool:
        return not self.attributes


_FR_PARTS: tuple[Box, ...] = ((-55, 1.5, -51, 6), (-60, 15.5, -62, 17), (-60, 14, -62, 15), (-63.3, 18, -62.8, 18.2), (44, -13.5, 45.5, -12.5), (54, -22, 56, -20))
_A = lambda name, iso3, iso2=None: {"NAME": name, "ISO3_CODE": iso3} | ({"ISO2_CODE": iso2} if iso2 else {})

#: Which parts of which country become regions of their own.
NATURAL_EARTH_RULES = (
    SplitRule("United States", "AK", ((-180, 47, -127, 73), (171, 50, 180, 54)), _A("Alaska (US)", "USA")),
    SplitRule("United States", "HI", ((-180, 18, -154, 27),), _A("Hawaii (US)", "USA")),
    SplitRule("United States", "US", ((-125, 24, -66.5, 50),)),
    SplitRule("China", "XA", ((110, 15, 114, 17.5),), {"NAME": "Paracel Islands (Disputed Territory)"}),
    SplitRule("China", "CN", ((70, 15, 140, 55),), {}, ((110, 15, 114, 17.5),)),
    SplitRule("France", "GF", ((-55, 1.5, -51, 6),), _A("French Guiana", "GUF")),
    SplitRule("France", "GP", ((-60, 15.5, -62, 17),), _A("Guadeloupe", "GLP")),
    SplitRule("France", "MQ", ((-60, 14, -62, 15),), _A("Martinique", "MTQ")),
    SplitRule("France", "MF", ((-63.3, 18, -62.8, 18.2),), _A("Saint Martin", "MAF")),
    SplitRule("France", "YT", ((44, -13.5, 45.5, -12.5),), _A("Mayotte", "MYT")),
    SplitRule("France", "RE", ((54, -22, 56, -20),), _A("Réunion", "REU")),
    SplitRule("France", "FR", ((-70, -25, 70, 70),), {}, _FR_PARTS),
    SplitRule("Indian Ocean Territories", "CX", ((105, -11, 106, -10),), _A("Christmas Island", "CXR", "CX")),
    SplitRule("Indian Ocean Territories", "CC", ((96, -13, 98, -11),), _A("Cocos (Keeling) Islands", "CCK", "CC")),
    SplitRule("Norway", "SJ", ((9, 73, 34, 82), (-10, 70, -7, 72)), _A("Svalbard and Jan Mayen", "SJM")),
    SplitRule("Norway", "BV", ((0, -56, 5, -53),), _A("Bouvet Island", "BVT")),
    SplitRule("Norway", "NO", ((3, 57, 32, 72),)),
    SplitRule("New Zealand", "TK", ((-174, -10, -170, -8),), _A("Tokelau", "TKL")),
    SplitRule("New Zealand", "NZ", ((-180, -90, 180, 90),), {}, ((-174, -10, -170, -8),)),
)
_TAIWAN: tuple[Box, ...] = ((119.8, 21.5, 123, 25.4), (119, 23, 119.8, 24))
#: The same for the Eurostat layer, whose sources are ids; local names come with the layer's own table.
EUROSTAT_RULES = (
    *(SplitRule("US", r.new_id, r.boxes, r.attributes, r.minus) for r in NATURAL_EARTH_RULES if r.source == "United States"),
    SplitRule("CN", "TW", _TAIWAN, _A("Taiwan", "TWN") | {"OL_NAME": "中華民國"}),
    SplitRule("CN", "CN", ((70, 15, 140, 55),), {}, _TAIWAN),
    *(SplitRule("FR", r.new_id, r.boxes, r.attributes | ({"OL_NAME": r.attributes["NAME"]} if r.attributes else {}), r.minus) for r in NATURAL_EARTH_RULES if r.source == "France"),
)
#: Merges of the country layer: key column, values, base row, overrides.
MERGES = (
    ("NAME", ("Australia", "Coral Sea Islands", "Ashmore and Cartier Islands"), "Australia", {}),
    ("NAME", ("Akrotiri", "Dhekelia", "Akrotiri Sovereign Base Area", "Dhekelia Sovereign Base Area"), None, {"NAME": "Cyprus U.K. Bases", "ID": "EWSB"}),
)
#: Codes that the country layer's source lacks, and sources whose parts are all regions of their own.
ISO3_OF_NAME = {"France": "FRA", "Norway": "NOR"}
SPLIT_WHOLE = ("Indian Ocean Territories",)
#: East of this meridian the Indian Ocean belongs to the South Pacific.
INDIAN_PACIFIC = 146.9167
INDIAN_OCEAN = ("INDIAN OCEAN", "SOUTH PACIFIC OCEAN (EAST)", "South Pacific Ocean")


def _norm(b: Box) -> Box:
    return min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])


def split_countries(table: DataFrame, rules: tuple[SplitRule, ...], key: str = "NAME", own_id: str = "ID") -> DataFrame:
    """All rules at once, against the table as it came in: main parts replace their region's geometry, others append rows.

    A part that two rules match is in both results; a part that none matches goes once the region has a main part.
    A rule that matches nothing changes nothing, and so does one whose source isn't there.
    """
    spark = table.sparkSession
    boxes = [(n, *_norm(b)) for n, r in enumerate(rules) for b in r.boxes]
    minus = [(n, *_norm(b)) for n, r in enumerate(rules) for b in r.minus]
    kind = "rule int, minx double, miny double, maxx double, maxy double"
    of = spark.createDataFrame([(n, r.source) for n, r in enumerate(rules)], "rule int, source string")
    parts = G.parts(table.select(F.col(key).alias("source"), "geometry").join(F.broadcast(of.select("source").distinct()), "source", "left_semi"))
    parts = parts.select("source", F.col("part").alias("place"), "geometry")
    rows = spark.createDataFrame([(float(a), float(b), float(c), float(d), n) for n, a, b, c, d in boxes], "minx double, miny double, maxx double, maxy double, rule int").withColumn("box_id", F.col("rule"))
    met = predicates.touching(parts, rows, ["source", "place"]).withColumnRenamed("box_id", "rule").join(F.broadcast(of), ["rule", "source"])
    if minus:
        # wholly inside one of the boxes taken out: such a part meets nothing else
        out = F.broadcast(spark.createDataFrame([(n, *map(float, b)) for n, *b in minus], kind))
        inner = parts.withColumn("b", G.bounds("geometry")).join(met, ["source", "place"]).join(out, "rule").filter("b.minx > minx and b.miny > miny and b.maxx < maxx and b.maxy < maxy")
        met = met.join(inner.select("rule", "source", "place").distinct(), ["rule", "source", "place"], "left_anti")
    chosen = met.join(parts, ["source", "place"]).groupBy("rule").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "geometry"))), lambda s: s["geometry"])).alias("_new"))
    main = F.broadcast(of.join(F.broadcast(spark.createDataFrame([(n, r.new_id) for n, r in enumerate(rules) if r.mainland] or [(-1, "")], "rule int, _id string")), "rule"))
    swap = chosen.join(main, "rule").select(F.col("source").alias("_source"), "_new")
    kept = table.join(swap, table[key] == F.col("_source"), "left").withColumn("geometry", F.coalesce("_new", "geometry")).drop("_new", "_source")
    names = [c for c, t in table.dtypes if t == "string" and c not in (own_id,)]
    fresh = spark.createDataFrame([(n, r.new_id, *[r.attributes.get(c) for c in names]) for n, r in enumerate(rules) if not r.mainland] or [(-1, None, *[None] * len(names))], "rule int, " + ", ".join(f"`{c}` string" for c in [own_id, *names]))
    added = chosen.join(F.broadcast(fresh), "rule").withColumnRenamed("_new", "geometry").drop("rule")
    return kept.unionByName(added, allowMissingColumns=True)


def united(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys, geometry``: the geometric union of each group's members, as polygons.

    Parts whose bounding box meets no other part's of the group stay as they are, in order; the polygons of the others'
    union follow.  Members that share more than a point become one part, holes and all.
    """
    # written: the union reads them several times; of parts that are alike in all points one does
    every = G.parts(table.select(*keys, F.col(order).alias("_o"), "geometry")).groupBy(*keys, "geometry")
    parts = settle(every.agg(F.min("_o").alias("_o"), F.min("part").alias("part"), F.count("*").alias("_n")).withColumn("_id", F.monotonically_increasing_id()))
    copied = parts.filter("_n > 1").select(*keys, "_id")
    met = settle(predicates.meeting_boxes(parts.select(*keys, "_id", G.bounds("geometry").alias("_b")), keys).unionByName(copied).distinct())
    on = [*keys, "_id"]
    alone = parts.join(met, on, "left_anti").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "part", F.col("geometry")[0].alias("p")))), lambda s: s["p"]).alias("_alone"))
    if met.isEmpty():
        return alone.withColumnRenamed("_alone", "geometry")
    edges = G.edges(parts.join(met, on, "left_semi").select(*keys, "geometry"), keys).select(*keys, *G.EDGE)
    joint = rings.polygons(boolean.repair(settle(edges), keys), keys).withColumnRenamed("geometry", "_joint")
    none = F.array().cast(G.GEOMETRY)
    return alone.join(joint, keys, "full").select(*keys, F.concat(F.coalesce("_alone", none), F.coalesce("_joint", none)).alias("geometry"))


def merge_regions(table: DataFrame, key: str, values: tuple[str, ...], base: str | None = None, overrides: Mapping[str, str] | None = None, order: str = "row_id") -> DataFrame:
    """One row for the rows with the values, their union: attributes of the base row, or else of the first, then the overrides; appended last."""
    chosen = table.filter(F.col(key).isin(*values))
    if chosen.isEmpty():
        raise ValueError(f"no row with {key} in {values}")
    rank = F.when(F.col(key) == base, 0).otherwise(1) if base is not None else F.lit(0)
    others = [c for c in table.columns if c != "geometry"]
    one = chosen.agg(F.min_by(F.struct(*others), F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("s")).withColumn("_one", F.lit(1))
    shape = united(chosen.withColumn("_one", F.lit(1)), ["_one"], order)
    new = one.join(shape, "_one", "left").select("s.*", "geometry")
    for c, v in (overrides or {}).items():
        new = new.withColumn(c, F.lit(v))
    return harmonise.delete_where(table, F.col(key).isin(*values)).unionByName(new.select(table.columns))


def dissolve(table: DataFrame, by: str, order: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each non-null key: the union of its members, other columns the first value that isn't null."""
    others = [c for c in (columns if columns is not None else table.columns) if c not in (by, "geometry")]
    first = [F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in others]
    own = table.filter(F.col(by).isNotNull())
    rows = own.groupBy(by).agg(*first) if first else own.select(by).distinct()
    return rows.join(united(own, [by], order), by, "left")


def dissolve_edges(edges: DataFrame, by: list[str], disjoint: bool = False) -> DataFrame:
    """Geometric union of each group's edges; disjoint members need no cutting."""
    own = edges.select(*by, *G.EDGE).na.drop(subset=by)
    return own if disjoint else boolean.repair(own, by)


def cut_at_meridian(table: DataFrame, name: str, value: str, meridian: float, parent: str, east: str, new_name: str | None = None) -> DataFrame:
    """The row with ``name == value`` keeps what lies west of the meridian; the rest is a new row with another parent, and another name if one is given."""
    own = F.col(name) == value
    half = lambda less: F.transform("geometry", lambda part: F.transform(part, lambda ring: G.clip_half(ring, "x", F.lit(meridian), less)))
    wide = G.bounds("geometry")
    west = table.withColumn("geometry", F.when(own & (wide["maxx"] > meridian), half(True)).otherwise(F.col("geometry")))
    new = table.filter(own & (wide["maxx"] > meridian)).withColumn("geometry", half(False)).withColumn(parent, F.lit(east))
    new = new if new_name is None else new.withColumn(name, F.lit(new_name))
    return west.unionByName(new)


def overlay_intersection(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """``a_id, b_id`` and edges of each pair's common area."""
    pairs = predicates.bounding_pairs(a, b, a_id, b_id)
    return boolean.pieces_of_pairs(G.edges(a, [a_id]), G.edges(b, [b_id]), pairs, "intersection", a_id, b_id)


def gaps(whole: DataFrame, covering: DataFrame, whole_id: str) -> DataFrame:
    """Edges of what no covering region covers, for each row of ``whole``."""
    own = covering.withColumn("_c", F.xxhash64("geometry"))
    pairs = predicates.bounding_pairs(whole, own, whole_id, "_c")
    cover = pairs.join(G.edges(own, ["_c"]), "_c")
    # written: the overlay reads its operands many times
    mine, theirs = (settle(e.select(whole_id, *G.EDGE)) for e in (G.edges(whole, [whole_id]), cover))
    return boolean.overlay(mine, theirs, "difference", [whole_id])


def gap_polygons(whole: DataFrame, covering: DataFrame, whole_id: str) -> DataFrame:
    """``whole_id, geometry``: the polygons of what no covering region covers; rows that are covered whole have none."""
    return rings.polygons(gaps(whole, covering, whole_id), [whole_id])


def group_seas(seas: DataFrame, names: DataFrame) -> DataFrame:
    """``parent_reg`` of each sea: its note where the name is missing, looked up in lower case, ``Other`` if unknown."""
    named = seas.withColumn("name", F.coalesce("name", "note"))
    return harmonise.dictionary_join(named, names, "name", "sea", "parent", "parent_reg")


def parts_of_rows(table: DataFrame, into: str) -> DataFrame:
    """One row for each part, numbered in ``into``: what exploding a layer gives."""
    own = G.parts(table)
    return own.drop("part").withColumn(into, F.monotonically_increasing_id())


def sea_regions(seas: DataFrame, ocean: DataFrame, names: DataFrame, cut: tuple[str, str, str] = INDIAN_OCEAN, meridian: float = INDIAN_PACIFIC, project: bool = True) -> DataFrame:
    """``parent_reg, geometry``: the ocean's water by the parent region of the sea that it belongs to.

    ``seas``: name, note, geometry; ``ocean``: geometry; ``names``: sea, parent.  Water of a sea is the sea's; each polygon of what no
    sea covers goes to the nearest one, to all of them if several are equally near.  The sea ``cut[0]`` ends at the
    meridian, and what lies east of it is another (``cut[1]``) of parent ``cut[2]``.
    """
    named = group_seas(seas, names)
    named = cut_at_meridian(named, "name", cut[0], meridian, "parent_reg", cut[2], cut[1])
    marine = settle(named.select(F.monotonically_increasing_id().alias("sea_id"), "parent_reg", "geometry").filter(F.size("geometry") > 0))
    water = settle(ocean.select(F.monotonically_increasing_id().alias("ocean_id"), "geometry"))
    parent = marine.select("sea_id", "parent_reg")
    # each piece with its level edges: the union counts all that crosses a strip's border
    own = settle(overlay_intersection(water, marine, "ocean_id", "sea_id"))
    main = rings.with_levels(own, ["ocean_id", "sea_id"]).join(parent, "sea_id").select("parent_reg", *G.EDGE)
    left = settle(parts_of_rows(gap_polygons(water, marine, "ocean_id"), "gap_id"))
    near = predicates.nearest(left.select("gap_id", "geometry"), marine.select("sea_id", "geometry"), "gap_id", "sea_id", project)
    owner = near.join(parent, "sea_id").select("gap_id", "parent_reg").distinct()
    gap_edges = G.edges(left.select("gap_id", "geometry"), ["gap_id"]).join(owner, "gap_id").select("parent_reg", *G.EDGE)
    return rings.polygons(boolean.repair(settle(main.unionByName(gap_edges)), ["parent_reg"]), ["parent_reg"])


def default_name(column: Column) -> Column:
    return F.coalesce(column, F.lit("Unassigned Marine Area"))
