"""Shapefile layers as a Python data source: polygons of ``.shp``, attributes of ``.dbf``, ``.cpg`` and ``.prj``.

``spark.read.format("cellshare_shapefile").load(path)``; a row is read by the offsets of ``.shx``, so a layer is
read in ``partitions`` ranges of records.  ``write_shapefile`` is the other way, for layers of bounded size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import GEOMETRY
from ..operators.harmonise import same_crs

POLYGON = 5
#: Kinds of shape that are read: nothing, and polygons, also with heights or measures, which follow x and y.
NOTHING, POLYGONS = 0, (POLYGON, 15, 25)
MAX_ROWS = 100_000


def _base(path: str) -> Path:
    return Path(path.removeprefix("file://").removeprefix("file:")).with_suffix("")


def _encoding(base: Path) -> str:
    cpg = base.with_suffix(".cpg")
    name = cpg.read_text().strip() if cpg.exists() else "utf-8"
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def _fields(base: Path) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Rows, header size, row size, and ``(name, kind, length, decimals)``."""
    with base.with_suffix(".dbf").open("rb") as f:
        n, head, size = struct.unpack("<4xIHH20x", f.read(32))
        raw = f.read(head - 33)
    fields = []
    for i in range(0, len(raw) - 31, 32):
        name, kind, length, decimals = struct.unpack("<11sc4xBB14x", raw[i : i + 32])
        fields.append((name.split(b"\0")[0].decode("ascii", "replace"), kind.decode(), length, decimals))
    return n, head, size, fields


def _type(kind: str, length: int, decimals: int) -> str:
    if kind in "NF":
        return "double" if decimals or kind == "F" or length > 18 else "bigint"
    return "boolean" if kind == "L" else "string"


def _value(raw: bytes, kind: str, length: int, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip("\0 ")
    if not text or (kind in "NF" and set(text) <= {"*"}):
        return None
    t = _type(kind, length, decimals)
    if t == "bigint":
        return int(float(text))
    if t == "double":
        return float(text)
    return text in "TtYy" if t == "boolean" else text


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hits = 0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        if (y0 > p[1]) != (y1 > p[1]) and x0 + (p[1] - y0) * (x1 - x0) / (y1 - y0) > p[0]:
            hits += 1
    return hits % 2 == 1


def _parts(rings: list[list[tuple[float, float]]]):
    """Outer rings (clockwise in the file) with their holes; both are turned to our orientation."""
    outer = [[r] for r in rings if _area(r) <= 0]
    for hole in (r for r in rings if _area(r) > 0):
        home = next((p for p in outer if _inside(hole[0], p[0])), None)
        if home is None:
            outer.append([hole[::-1]])
        else:
            home.append(hole)
    return [[[{"x": x, "y": y} for x, y in reversed(r)] for r in p] for p in outer]


def _polygon(content: bytes):
    kind = struct.unpack_from("<i", content)[0]
    if kind == NOTHING:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shapes of kind {kind} aren't polygons")
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", content, 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    return _parts([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int) -> None:
        self.base, self.parts = _base(path), parts

    def partitions(self) -> list[InputPartition]:
        n = _fields(self.base)[0]
        step = max(1, -(-n // self.parts))
        return [_Range(a, min(n, a + step)) for a in range(0, n, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        _, head, size, fields = _fields(self.base)
        encoding = _encoding(self.base)
        with self.base.with_suffix(".shp").open("rb") as shp, self.base.with_suffix(".shx").open("rb") as shx, self.base.with_suffix(".dbf").open("rb") as dbf:
            for i in range(partition.first, partition.last):
                shx.seek(100 + 8 * i)
                at, length = struct.unpack(">ii", shx.read(8))
                shp.seek(2 * at + 8)
                shape = _polygon(shp.read(2 * length))
                dbf.seek(head + size * i)
                row, k, values = dbf.read(size), 1, []
                for _, kind, n, decimals in fields:
                    values.append(_value(row[k : k + n], kind, n, decimals, encoding))
                    k += n
                yield (*values, shape)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellshare_shapefile"

    def schema(self) -> str:
        fields = _fields(_base(self.options["path"]))[3]
        return ", ".join([*(f"`{n}` {_type(k, size, d)}" for n, k, size, d in fields), f"geometry {GEOMETRY}"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitions", "8")))


def read_shapefile(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("cellshare_shapefile").option("partitions", partitions).load(path)


def crs(path: str) -> str | None:
    """The text of the layer's ``.prj``, if there is one."""
    prj = _base(path).with_suffix(".prj")
    return prj.read_text().strip() if prj.exists() else None


def crs_key(text: str) -> str:
    """What tells reference systems in this text form apart: neither space between its parts, nor case outside quotes, nor how numbers are written."""
    out = []
    for k, bit in enumerate(text.strip().split('"')):
        bare = re.sub(r"\s+", "", bit).upper()
        out.append(bit if k % 2 else re.sub(r"-?\d+(?:\.\d*)?(?:[E][-+]?\d+)?", lambda m: repr(float(m.group())), bare))
    return '"'.join(out)


def aligned(a: str, b: str, strict: bool = True) -> bool:
    """Whether two layers have one reference system by their ``.prj``; raises if they must and don't, or if one has none."""
    texts = [crs(p) for p in (a, b)]
    if None in texts:
        if strict:
            raise ValueError(f"no reference system beside {[p for p, t in zip((a, b), texts, strict=True) if t is None]}")
        return False
    return same_crs(*map(crs_key, texts), strict=strict)


def write_shapefile(table: DataFrame, path: str, prj: str | None = None) -> None:
    """One layer of at most ``MAX_ROWS`` regions, overwriting; larger ones go to Parquet."""
    rows = table.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} regions")
    base = _base(path)
    base.parent.mkdir(parents=True, exist_ok=True)
    names = [c for c in table.columns if c != "geometry"]
    numeric = {c: t in ("int", "bigint", "smallint", "tinyint") for c, t in table.dtypes}
    real = {c: t in ("double", "float") for c, t in table.dtypes}
    text = lambda c, v: "" if v is None else (f"{v:.10g}" if real[c] else str(v))
    cells = {c: [text(c, r[c]).encode() for r in rows] for c in names}
    width = {c: min(254, max([1, *map(len, cells[c])])) for c in names}
    head = b"".join(struct.pack("<11sc4xBB14x", c.encode()[:10], b"N" if numeric[c] else b"F" if real[c] else b"C", width[c], 0) for c in names)
    with base.with_suffix(".dbf").open("wb") as f:
        f.write(struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(rows), 33 + len(head), 1 + sum(width.values())) + head + b"\r")
        for i in range(len(rows)):
            f.write(b" " + b"".join(cells[c][i][: width[c]].rjust(width[c]) if numeric[c] or real[c] else cells[c][i][: width[c]].ljust(width[c]) for c in names))
    shapes, every = [], []
    for r in rows:
        rings = [[(p["x"], p["y"]) for p in reversed(ring)] for part in r["geometry"] or [] for ring in part]
        points = [p for ring in rings for p in ring]
        every += points
        if not points:
            shapes.append(struct.pack("<i", 0))
            continue
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts, k = [], 0
        for ring in rings:
            starts.append(k)
            k += len(ring)
        shapes.append(struct.pack("<i4dii", POLYGON, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points))
    box = (min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every)) if every else (0.0,) * 4
    top = lambda words: struct.pack(">i20xi", 9994, words) + struct.pack("<ii8d", 1000, POLYGON, *box, 0, 0, 0, 0)
    with base.with_suffix(".shp").open("wb") as shp, base.with_suffix(".shx").open("wb") as shx:
        shp.write(top(50 + sum(4 + len(s) // 2 for s in shapes)))
        shx.write(top(50 + 4 * len(shapes)))
        at = 50
        for i, s in enumerate(shapes):
            shp.write(struct.pack(">ii", i + 1, len(s) // 2) + s)
            shx.write(struct.pack(">ii", at, len(s) // 2))
            at += 4 + len(s) // 2
    base.with_suffix(".cpg").write_text("UTF-8")
    if prj:
        base.with_suffix(".prj").write_text(prj)
