"""The array on disk: what comes back, what it looks like to others, what a failed write leaves."""

import json
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellshare.functions import geometry as G
from cellshare.operators import coverage
from cellshare.plans.grid import Grid
from cellshare.sources import arrays

GRID = Grid(0, 0, 10, 7, 1)


def mask_of(spark, normalise):
    rows = [("b", 0.5, 0.5, 3.25, 2.0), ("a", 2.0, 1.0, 6.0, 6.5), ("é", 9.5, 6.5, 10.0, 7.0)]
    t = G.from_boxes(spark.createDataFrame(rows, "region_id string, minx double, miny double, maxx double, maxy double"))
    cells = coverage.coverage(G.edges(t, ["region_id"]), GRID)
    return coverage.normalise(cells) if normalise else cells, t.unionByName(t.limit(1).withColumn("region_id", F.lit("none")))


@pytest.mark.parametrize(("normalise", "chunk"), [(False, (2, 3, 4)), (True, (2, 3, 4)), (True, (16, 64, 64))])
def test_round_trip(spark, tmp_path, normalise, chunk):
    mask, regions = mask_of(spark, normalise)
    path = str(tmp_path / "array")
    arrays.write_array(mask, regions, GRID, path, normalise, chunk=chunk, metadata='[{"region_id": "a"}]')
    key = lambda r: (r.region_id, r.row, r.col, "nan" if math.isnan(r.frac) else r.frac)
    want = {key(r) for r in coverage.densify(mask, GRID, regions, normalise).collect() if r.frac != 0}
    got = {key(r) for r in arrays.read_array(spark, path).collect()}
    if normalise:  # chunks without a file are NaN and aren't listed
        assert got <= want and {g for g in got if g[3] != "nan"} == {w for w in want if w[3] != "nan"}
    else:
        assert got == want
    # by the layout alone: every cell of the array
    about = json.load(open(f"{path}/mask/.zarray"))
    full = np.full([-(-s // c) * c for s, c in zip(about["shape"], about["chunks"], strict=True)], np.nan if about["fill_value"] == "NaN" else about["fill_value"], about["dtype"])
    for name in os.listdir(f"{path}/mask"):
        if not name.startswith("."):
            at = [int(v) * c for v, c in zip(name.split("."), chunk, strict=True)]
            full[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))] = np.frombuffer(zlib.decompress(open(f"{path}/mask/{name}", "rb").read()), "<f4").reshape(chunk)
    full = full[tuple(slice(0, s) for s in about["shape"])]
    ids = ["a", "b", "none", "é"]
    assert full.shape == (4, 7, 10)
    for r in coverage.densify(mask, GRID, regions, normalise).collect():
        v = full[ids.index(r.region_id), r.row, r.col]
        assert v == r.frac or (math.isnan(v) and math.isnan(r.frac))
    attributes = arrays.read_attributes(path)
    assert attributes["transform"] == list(GRID.transform) and attributes["crs"] == "EPSG:4326" and attributes["metadata"] == '[{"region_id": "a"}]'
    assert not [x for x in os.listdir(path) if x.startswith(".parts")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(arrays.ChunkSink)
    path = str(tmp_path / "array")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    bad = spark.range(0, 8, 1, 1).select(F.concat(F.lit("mask/0.0."), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit(b"x")).cast("binary").alias("data"))
    try:
        with pytest.raises(Exception, match="no"):
            bad.write.format("cellshare_chunks").mode("append").save(path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not os.path.exists(path) or os.listdir(path) == []
