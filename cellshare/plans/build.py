"""The whole way from a boundary layer to a stored mask, and the country layer's steps, composed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import boolean, coverage, harmonise, layers, validity
from ..sources import shapefile, tables
from ..sources.scratch import settle
from .config import MaskConfig
from .grid import Grid


def split_valid(layer: DataFrame, region: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose geometry is valid, and those whose isn't; rows without a geometry, or with an empty one, go."""
    own = layer.select(region, "geometry").filter(F.col("geometry").isNotNull() & (F.size("geometry") > 0))
    bad = validity.check(own, [region]).filter("not valid").select(region)
    return own.join(bad, region, "left_anti"), own.join(bad, region, "left_semi")


def mask(layer: DataFrame, grid: Grid, region: str = "region_id", normalise: bool = True, repair: bool = True) -> DataFrame:
    """``region, row, col, frac``: invalid regions repaired, all moved into the grid's turn of longitude, covered, normalised.

    Regions without a geometry or with an empty one have no cells.  Repair counts overlapping parts and
    self-crossings once; only regions that aren't valid go through it.
    """
    edges = lambda rows: G.edges(rows, [region]).select(region, *G.EDGE)
    if repair:
        good, bad = split_valid(layer, region)
        every = edges(good) if bad.isEmpty() else edges(good).unionByName(boolean.repair(edges(bad), [region]))
    else:
        every = edges(layer.select(region, "geometry").filter(F.col("geometry").isNotNull()))
    if grid.max_lon > 180:
        every = coverage.wrap_longitude(every, grid.min_lon, [region])
    cells = coverage.coverage(every, grid, region)
    return coverage.normalise(cells) if normalise else cells


def read(spark: SparkSession, path: str) -> DataFrame:
    """A layer from a shapefile or, by any other name, from Parquet."""
    return shapefile.read_shapefile(spark, path) if path.endswith(".shp") else tables.read_layer(spark, path)


def run(spark: SparkSession, config: MaskConfig, region: str = "ID") -> DataFrame:
    """Read the settings' layer, write its mask with attributes and metadata, and read that back."""
    layer = read(spark, config.layer_path).filter(F.col(region).isNotNull())
    tables.write_mask(mask(layer, config.grid, region, config.normalise), layer, config.grid, config.mask_path, region)
    return tables.read_mask(spark, config.mask_path, region=region)


def countries(table: DataFrame, codes: DataFrame, rules: tuple[layers.SplitRule, ...] = layers.NATURAL_EARTH_RULES, merges: tuple = layers.MERGES, source: str = "natural_earth_countries") -> DataFrame:
    """The country layer: common columns, ids from the code table, territories split off and merged, ISO codes.

    After the split, countries whose own codes are missing get them, and sources that are split whole go.  ``codes`` has the columns of
    ``tables.CODE_COLUMNS``; merges whose rows aren't in the table are left out.
    """
    own = harmonise.prepare(table, harmonise.COUNTRIES_SCHEMA, harmonise.COLUMN_MAPS[source], {"SOURCE": harmonise.SOURCES[source]})
    own = harmonise.sentinel_to_null(own, ["ISO3_CODE", "ISO2_CODE", "ISON_CODE"])
    numbered = codes.withColumns({"NE_ID": harmonise.to_number(F.col("NE_ID")), "NUM_ID": harmonise.to_number(F.col("NUM_ID"))})
    own = harmonise.lookup(own, numbered, "NE_ID", "NE_ID", "ID", "ID", order="NUM_ID")
    own = layers.split_countries(own.withColumn("row_id", F.xxhash64("NAME", "NE_ID")), rules)
    for name, code in layers.ISO3_OF_NAME.items():
        own = own.withColumn("ISO3_CODE", F.when(F.col("NAME") == name, code).otherwise(F.col("ISO3_CODE")))
    own = settle(harmonise.delete_where(own, F.col("NAME").isin(*layers.SPLIT_WHOLE)))
    for key, values, base, overrides in merges:
        if not own.filter(F.col(key).isin(*values)).isEmpty():
            own = layers.merge_regions(own, key, values, base, overrides)
    own = harmonise.lookup(own, numbered, "ID", "ID", "NUM_ID", "NUM_ID", order="NUM_ID")
    iso = harmonise.iso_dimension(numbered.toDF(*[c.lower() for c in numbered.columns]))
    return harmonise.enrich_iso(own, iso).select(*harmonise.COUNTRIES_SCHEMA, "geometry")


def seas(seas_table: DataFrame, ocean: DataFrame, names: DataFrame, codes: DataFrame, **settings) -> DataFrame:
    """The sea layer: the ocean's water by parent region (``settings`` go to ``layers.sea_regions``), ids from the names, numbers from the code table."""
    regions = layers.sea_regions(seas_table, ocean, names, **settings)
    own = harmonise.prepare(regions, harmonise.SEAS_SCHEMA, {"parent_reg": "NAME"}, {"SOURCE": harmonise.SOURCES["natural_earth_seas"]})
    own = own.withColumn("ID", harmonise.sea_id(F.col("NAME")))
    numbered = codes.withColumn("NUM_ID", harmonise.to_number(F.col("NUM_ID")))
    return harmonise.lookup(own, numbered, "ID", "ID", "NUM_ID", "NUM_ID", order="NUM_ID").select(*harmonise.SEAS_SCHEMA, "geometry")


def countries_and_seas(land: DataFrame, sea: DataFrame) -> DataFrame:
    """Both layers as one, columns of either kept."""
    return harmonise.union_layers(land, sea)
