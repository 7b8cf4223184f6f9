"""Code tables, layers and masks: readers and writers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.harmonise import NULL_TOKENS, null_tokens
from ..plans.grid import Grid

#: Columns of the code table.
CODE_COLUMNS = ("ID", "NAME", "NE_NAME", "NE_ID", "EUROSTAT_NAME", "EUROSTAT_ID", "ISO3_CODE", "ISO2_CODE", "ISON_CODE", "NUM_ID")


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and delimiter of a table from its first bytes."""
    for name in ("utf-8-sig", "utf-8", "cp1252", "latin-1"):
        try:
            text = head.decode(name)
            break
        except UnicodeDecodeError as e:
            if name.startswith("utf-8") and e.start > len(head) - 4:  # cut inside a character
                text = head[: e.start].decode(name)
                break
    try:
        sep = csv.Sniffer().sniff(text, ",;\t|").delimiter
    except csv.Error:
        sep = ","
    return ("utf-8" if name == "utf-8-sig" else name), sep


def read_codes(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """A code table, all strings; encoding and delimiter are read off its first bytes unless given."""
    if encoding is None or sep is None:
        head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("h")).limit(1).collect()[0].h)
        found = sniff(head)
        encoding, sep = encoding or found[0], sep or found[1]
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, nullValue="\0", emptyValue="", escape='"', multiLine=True)
    return null_tokens(raw, tokens)


def write_layer(layer: DataFrame, path: str) -> None:
    """Parquet with bounding boxes, so that readers skip row groups."""
    from ..functions.geometry import bounds

    b = bounds("geometry")
    layer.withColumns({f"_{k}": b[k] for k in ("minx", "miny", "maxx", "maxy")}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    layer = spark.read.parquet(path)
    if box:
        x0, y0, x1, y1 = box
        layer = layer.filter((F.col("_minx") <= x1) & (F.col("_maxx") >= x0) & (F.col("_miny") <= y1) & (F.col("_maxy") >= y0))
    return layer.drop("_minx", "_miny", "_maxx", "_maxy")


def geojson(layer: DataFrame) -> DataFrame:
    """One GeoJSON feature in each row's ``value``."""
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("geometry", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))).alias("coordinates"))
    own = F.struct(*[c for c in layer.columns if c != "geometry"])
    return layer.select(F.to_json(F.struct(F.lit("Feature").alias("type"), own.alias("properties"), shape.alias("geometry")), {"ignoreNullFields": "false"}).alias("value"))


def metadata(layer: DataFrame) -> DataFrame:
    """A region's attributes as JSON, nulls included, without the geometry."""
    cols = [c for c in layer.columns if c != "geometry"]
    return layer.select(*cols[:1], F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("metadata"))


def metadata_list(layer: DataFrame, order: str) -> DataFrame:
    """All records as one JSON list; for layers of bounded size, as the mask's attribute."""
    cols = [c for c in layer.columns if c != "geometry"]
    return layer.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("r")))), lambda s: s["r"]), {"ignoreNullFields": "false"}).alias("metadata"))


def hilbert(row: Column, col: Column, bits: int) -> Column:
    """Place of a cell along the Hilbert curve through ``2**bits`` rows and columns: near in place is near on the map."""
    # an array of one, so that each step names the state before it once
    state = F.array(F.struct(col.cast("long").alias("x"), row.cast("long").alias("y"), F.lit(0).cast("long").alias("d")))
    for k in reversed(range(bits)):
        state = F.transform(state, _hilbert_step(1 << k))
    return state[0]["d"]


def _hilbert_step(side: int):
    """Which quarter of a square a cell is in, and the cell as that quarter's own curve sees it."""

    def step(t: Column) -> Column:
        right, up = t["x"].bitwiseAND(F.lit(side)) != 0, t["y"].bitwiseAND(F.lit(side)) != 0
        quarter = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        inside = lambda c: t[c].bitwiseAND(F.lit(side - 1))
        x = F.when(up, inside("x")).when(right, side - 1 - inside("y")).otherwise(inside("y"))
        y = F.when(up, inside("y")).when(right, side - 1 - inside("x")).otherwise(inside("x"))
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (t["d"] + quarter.cast("long") * side * side).alias("d"))

    return step


def write_mask(mask: DataFrame, layer: DataFrame, grid: Grid, path: str, region: str = "region_id", description: str = "fraction of each cell that a region covers", group_bytes: int = 8 << 20) -> None:
    """Sparse mask, its attributes, and the regions' metadata.

    Cells lie along a Hilbert curve: each file holds a stretch of it, and within a file rows are in order of region, row and column, in row
    groups of ``group_bytes``.  So the bounds that Parquet keeps let a reader of one region, or of one box, skip most groups,
    and files are as many as the size asks for, however many regions there are.
    """
    spark = mask.sparkSession
    bits = max(grid.width, grid.height, 2) - 1
    placed = mask.withColumn("frac", F.col("frac").cast("float")).withColumn("_place", hilbert(F.col("row"), F.col("col"), bits.bit_length()))
    laid = placed.repartitionByRange("_place").sortWithinPartitions(region, "row", "col").drop("_place")
    laid.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(f"{path}/mask")
    attrs = [(list(map(float, grid.transform)), "EPSG:4326", float(grid.resolution), description, grid.width, grid.height)]
    spark.createDataFrame(attrs, "transform array<double>, crs string, resolution double, description string, width int, height int").coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")
    metadata(layer).write.mode("overwrite").parquet(f"{path}/metadata")


def read_mask(spark: SparkSession, path: str, region_id: str | None = None, region: str = "region_id", cells: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The mask, one region of it (one that isn't there raises), or what lies in ``cells``: first and last row, first and last column.

    Both conditions reach the scan.
    """
    mask = spark.read.parquet(f"{path}/mask")
    if cells is not None:
        mask = mask.filter(F.col("row").between(*cells[:2]) & F.col("col").between(*cells[2:]))
    if region_id is None:
        return mask
    one = mask.filter(F.col(region) == region_id)
    if one.isEmpty():
        raise KeyError(region_id)
    return one


def describe(layer: DataFrame, key: str, value: str, column: str) -> DataFrame:
    """One row: the column of the record with the key, or ``Unknown``."""
    return layer.filter(F.col(key) == value).agg(F.coalesce(F.max(column), F.lit("Unknown")).alias(column))
