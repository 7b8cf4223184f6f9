"""How a stored mask lies on disk: the curve, and what readers of a region or a box can skip."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cellshare.plans.grid import Grid
from cellshare.sources import tables


def test_hilbert_curve(spark):
    for bits in (1, 3, 5):
        n = 1 << bits
        cells = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("r"), F.expr(f"cast(id % {n} as int)").alias("c"))
        way = sorted((r.d, r.r, r.c) for r in cells.select("r", "c", tables.hilbert(F.col("r"), F.col("c"), bits).alias("d")).collect())
        assert [d for d, _, _ in way] == list(range(n * n))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(way, way[1:], strict=False))


def test_readers_skip_most_groups(spark, tmp_path):
    """Many regions of neighbouring cells: one of them, or a box, is in few of the row groups, and in few files."""
    grid, path = Grid(0, 0, 256, 256, 1), str(tmp_path / "m")
    cells = spark.range(256 * 256).select(F.expr("cast(id div 256 as int)").alias("row"), F.expr("cast(id % 256 as int)").alias("col"))
    mask = cells.select(F.format_string("r%03d", F.expr("(row div 16) * 16 + col div 16")).alias("region_id"), "row", "col", F.lit(1.0).alias("frac"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_mask(mask, mask.select("region_id").distinct(), grid, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    groups = []
    for f in Path(path, "mask").glob("*.parquet"):
        m = pq.read_metadata(f)
        for g in range(m.num_row_groups):
            stats = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c).statistics for c in range(3)}
            groups.append({c: (s.min, s.max) for c, s in stats.items()})
    assert len(groups) >= 8
    meets = lambda g, row, col: g["row"][0] <= row[1] and row[0] <= g["row"][1] and g["col"][0] <= col[1] and col[0] <= g["col"][1]
    assert sum(meets(g, (100, 107), (100, 107)) for g in groups) <= len(groups) // 4
    box = tables.read_mask(spark, path, cells=(100, 107, 100, 107))
    assert box.count() == 64 and box.filter("row < 100 or row > 107 or col < 100 or col > 107").isEmpty()
    assert tables.read_mask(spark, path, "r017").count() == 256
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(row,100)" in plan and "LessThanOrEqual(row,107)" in plan


def test_reference_systems(tmp_path):
    import pytest

    from cellshare.sources import shapefile

    texts = {"a": 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.25]]]', "b": 'geogcs["WGS 84", DATUM["WGS_1984",\n SPHEROID["WGS 84", 6378137.0, 298.250]]]\n', "c": 'GEOGCS["WGS 85"]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.prj").write_text(text)
    path = lambda n: str(tmp_path / f"{n}.shp")
    assert shapefile.aligned(path("a"), path("b")) and not shapefile.aligned(path("a"), path("c"), strict=False) and not shapefile.aligned(path("a"), path("none"), strict=False)
    for other in ("c", "none"):
        with pytest.raises(ValueError, match="reference system"):
            shapefile.aligned(path("a"), path(other))
