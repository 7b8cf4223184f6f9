"""Masks as a chunked, labelled array on disk: the public Zarr layout, version 2.

A folder holds the array ``mask`` (region, lat, lon; float32, zlib level 5, chunks of a chosen size), the coordinates ``region``, ``lat`` and
``lon``, and attributes as JSON.  Chunks are made where their cells are and written by the tasks; a chunk without a file is all fill
value.  Tasks write beside the array, under names of their own; the commit moves their chunks into place and writes the
description last, so that an array that can be opened is whole.  An abort removes what tasks have left; one that is still
running then may leave a hidden folder, which no reader looks at.

Each region has a number, its place in order of ids, so work is dealt by blocks of regions, rows and columns; no
region, and no cell of all regions, is ever whole in one task.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.grid import Grid

CHUNK = (16, 64, 64)
LEVEL = 5


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _put(path: str, name: str, data: bytes) -> None:
    where, base = _at(path)
    full = f"{base}/{name}"
    where.create_dir(full.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(full) as f:
        f.write(data)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str], folder: str) -> None:
        self.names, self.folder = names, folder


class _ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.parts = path, f".parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        folder, names = f"{self.parts}/{uuid.uuid4().hex}", []  # a task that runs again has another
        for b in iterator:
            for name, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), strict=True):
                _put(self.path, f"{folder}/{name}", data)
                names.append(name)
        return _Written(names, folder)

    def commit(self, messages: list[_Written | None]) -> None:
        where, base = _at(self.path)
        for m in filter(None, messages):
            for name in m.names:
                where.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                where.move(f"{base}/{m.folder}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        where, base = _at(self.path)
        if where.get_file_info(f"{base}/{self.parts}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.parts}")


class ChunkSink(DataSource):
    """Rows ``name, data`` become files of a folder, all or none."""

    @classmethod
    def name(cls) -> str:
        return "cellshare_chunks"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ChunkWriter(self.options["path"])


def _blocks(chunk: tuple[int, int, int], normalised: bool):
    """A chunk's bytes from its cells; number -1 stands for a cell that some region covers."""

    def run(t: pa.Table) -> pa.Table:
        n, row, col, frac = (t.column(c).to_numpy() for c in ("number", "row", "col", "frac"))
        block = np.full(chunk, np.nan if normalised else 0.0, "<f4")
        seen = n < 0
        block[:, row[seen] % chunk[1], col[seen] % chunk[2]] = 0.0
        own = ~seen
        block[n[own] % chunk[0], row[own] % chunk[1], col[own] % chunk[2]] = frac[own]
        name = f"mask/{'.'.join(str(t.column(c)[0].as_py()) for c in ('i', 'j', 'k'))}"
        return pa.table({"name": [name], "data": pa.array([zlib.compress(block.tobytes(), LEVEL)], pa.binary())})

    return run


def write_array(mask: DataFrame, regions: DataFrame, grid: Grid, path: str, normalised: bool, region: str = "region_id", chunk: tuple[int, int, int] = CHUNK,
                crs: str = "EPSG:4326", description: str = "Fractional coverage of regions (0.0 to 1.0)", metadata: str | None = None) -> None:
    """Write ``region, row, col, frac`` of the regions of ``regions`` (one row each, in order of id) as an array in an empty or new folder.

    Cells of a region that it doesn't cover are 0; in a normalised mask, cells that no region covers are NaN.
    The description is small but for the coordinate of regions: their ids come to the driver as its labels.
    """
    spark = mask.sparkSession
    spark.dataSource.register(ChunkSink)
    ids = [r[0] for r in regions.select(F.col(region).cast("string")).distinct().orderBy(region).collect()]
    numbered = spark.createDataFrame(list(enumerate(ids)), "number int, _id string")
    cells = mask.join(numbered, F.col(region).cast("string") == F.col("_id")).select("number", "row", "col", F.col("frac").cast("float").alias("frac"))
    deep = -(-max(1, len(ids)) // chunk[0])
    dealt = cells.withColumn("i", F.floor(F.col("number") / chunk[0]))
    if normalised:
        covered = mask.select("row", "col").distinct().select(F.lit(-1).alias("number"), "row", "col", F.lit(0.0).cast("float").alias("frac"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deep - 1).cast("long"))).alias("i"))
        dealt = dealt.unionByName(covered)
    dealt = dealt.withColumns({"j": F.floor(F.col("row") / chunk[1]), "k": F.floor(F.col("col") / chunk[2])})
    dealt.groupBy("i", "j", "k").applyInArrow(_blocks(chunk, normalised), "name string, data binary").write.format("cellshare_chunks").mode("append").save(path)
    fill = "NaN" if normalised else 0.0
    about = lambda shape, chunks, dtype, fill: {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": "zlib", "level": LEVEL}, "fill_value": fill, "order": "C", "filters": None}
    text = lambda v: json.dumps(v, ensure_ascii=False).encode()
    wide = max([1, *map(len, ids)])
    axes = {"region": np.array(ids, f"<U{wide}"), "lat": grid.max_lat - (np.arange(grid.height) + 0.5) * grid.dy, "lon": grid.min_lon + (np.arange(grid.width) + 0.5) * grid.dx}
    for name, values in axes.items():
        values = values if name == "region" else values.astype("<f8")
        _put(path, f"{name}/.zarray", text(about([len(values)], [max(1, len(values))], values.dtype.str, None if name == "region" else "NaN")))
        _put(path, f"{name}/.zattrs", text({"_ARRAY_DIMENSIONS": [name]}))
        _put(path, f"{name}/0", zlib.compress(values.tobytes(), LEVEL))
    attributes = {"_ARRAY_DIMENSIONS": ["region", "lat", "lon"], "transform": list(grid.transform), "crs": crs, "resolution": grid.resolution, "description": description, "metadata": metadata}
    _put(path, "mask/.zattrs", text(attributes))
    _put(path, "mask/.zarray", text(about([len(ids), grid.height, grid.width], list(chunk), "<f4", fill)))
    _put(path, ".zgroup", text({"zarr_format": 2}))


def read_attributes(path: str) -> dict:
    where, base = _at(path)
    with where.open_input_stream(f"{base}/mask/.zattrs") as a, where.open_input_stream(f"{base}/mask/.zarray") as b:
        return json.loads(a.read()) | {"array": json.loads(b.read())}


def _cells(chunk: list[int], shape: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = [int(v) * c for v, c in zip(path.rsplit("/", 1)[1].split("."), chunk, strict=True)]
                block = np.frombuffer(zlib.decompress(data), "<f4").reshape(chunk)
                block = block[tuple(slice(0, max(0, s - a)) for s, a in zip(shape, at, strict=True))]
                n, row, col = (x.astype(np.int32) + a for x, a in zip(np.nonzero(~(block == 0)), at, strict=True))
                values = block[~(block == 0)]
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(row), pa.array(col), pa.array(values)], names=["number", "row", "col", "frac"])

    return run


def read_array(spark: SparkSession, path: str, region: str = "region_id") -> DataFrame:
    """``region, row, col, frac`` of all cells other than zero, NaN ones included; chunks are read by Spark's own reader."""
    about = read_attributes(path)["array"]
    where, base = _at(path)
    with where.open_input_stream(f"{base}/region/.zarray") as a, where.open_input_stream(f"{base}/region/0") as b:
        ids = np.frombuffer(zlib.decompress(b.read()), json.loads(a.read())["dtype"]).tolist()
    names = spark.createDataFrame(list(enumerate(ids)), f"number int, {region} string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(f"{path}/mask").select("path", "content")
    return files.mapInArrow(_cells(about["chunks"], about["shape"]), "number int, row int, col int, frac float").join(names, "number").select(region, "row", "col", "frac")
