"""What several operators share: scratch tables, Arrow blocks, vectorised word hashing, components.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes.  A block is a bounded slice of an Arrow batch (a
single longer text is a block of its own), so the memory of a Python worker doesn't grow with the input.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U64, endpoint=False)
_MUL = U64(0x9E3779B97F4A7C15)
_LONG_WORD = 64
#: What crosses to a Python worker at once, whatever the rows hold.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


#: Seconds between two collections of garbage that free shuffle files, and between two in the executors.
PAUSE = 2.0
REST = 15.0
#: What tasks leave in a Python worker for the next of their kind.
held: dict = {}


# --------------------------------------------------------------------------------------------- session
def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once for each SparkContext; bound Arrow batches."""
    sc = spark.sparkContext
    for k, most in BATCH.items():
        held = spark.conf.get(k).rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(k, most)
    if not getattr(sc, "_cellshare_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(target)
        sc._cellshare_shipped = True
    rest(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine.

    It lies in a folder of this application, which is removed when Python ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif sc.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="cellshare_")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    own = f"{base}/cellshare_{sc.applicationId}"
    if getattr(sc, "_cellshare_scratch", None) != own:
        sc._cellshare_scratch = own
        atexit.register(lambda: sc._jsc is not None and _remove(spark, own))
    return f"{own}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Remove the tables of frames from ``materialise`` that nothing reads any more; other frames have none."""
    for df in frames:
        if "_cellshare_path" in vars(df):
            _remove(df.sparkSession, df._cellshare_path)


def materialise(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", codec).parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellshare_path = path
    return out


def release(spark: SparkSession, flush: bool = False) -> None:
    """Let Spark drop the shuffle files of steps that nothing refers to any more; for small steps not each time.

    The listeners refer to the last query until there is another; ``flush`` runs a small one.
    """
    sc = spark.sparkContext
    if flush:
        spark.range(1).collect()
    elif time.monotonic() - getattr(sc, "_cellshare_released", 0.0) < PAUSE:
        return
    gc.collect()
    trim()
    sc._jvm.System.gc()
    sc._cellshare_released = time.monotonic()
    rest(spark)


def rest(spark: SparkSession) -> None:
    """Let the executors collect their garbage, now and then.

    A JVM keeps the heap that its busiest step has needed and gives it back in full collections only, while the
    Python workers of the next step need memory beside it.  One short task for each core: all executors get some.
    """
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local" or time.monotonic() - getattr(sc, "_cellshare_rested", float("-inf")) < REST:
        return
    n = sc.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    sc._cellshare_rested = time.monotonic()


def trim() -> None:
    """Give back what this process has freed: Arrow's pool and the C library keep it, unless asked (glibc alone can be)."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def begin(holds: bool) -> None:
    """In a worker: a task of another kind needs none of what is held."""
    if not holds and held:
        held.clear()
        trim()


def lean(fn: Callable, holds: bool = False) -> Callable:
    """``fn`` for ``mapInArrow``; afterwards the worker, which waits for its next task, gives back what it has freed.

    ``holds``: the tasks use what others of their kind have left in ``held``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(holds)
        yield from fn(batches)
        trim()

    return run


def partitions(spark: SparkSession) -> int:
    """Number of buckets for key-dealt data: follows the session's shuffle setting, which follows the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------------------------------------- blocks
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy where possible; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = column.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[offs[0] : offs[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a finaliser of the xor-shift-multiply kind)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    black = ~_WS[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, ~black[:-1]
    after[-1], after[:-1] = True, ~black[1:]
    cut = offs[1:-1]
    before[cut[cut < len(data)]] = True
    after[cut[cut > 0] - 1] = True
    starts, ends = np.flatnonzero(black & before), np.flatnonzero(black & after) + 1
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; the same in every process and for every block."""
    n = len(starts)
    lens = ends - starts
    order = np.argsort(-np.minimum(lens, _LONG_WORD + 1).astype(np.int16), kind="stable")
    s, size = starts[order], lens[order]
    h = np.zeros(n, U64)
    long = int(np.searchsorted(-size, -_LONG_WORD, "left")) if n else 0
    top = int(size[long]) if long < n else 0
    live = np.searchsorted(-size, -np.arange(top), "left") if n else []
    for j in range(top):
        k = int(live[j])
        if k > long:
            h[long:k] = (h[long:k] ^ _BYTE[data[s[long:k] + j]]) * _MUL
    for i in range(long):
        h[i] = U64(xxhash.xxh3_64_intdigest(data[s[i] : s[i] + size[i]].tobytes()))
    out = np.empty(n, U64)
    out[order] = mix(h ^ size.astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours in ``h`` (texts aren't told apart here)."""
    if len(h) < width:
        return np.zeros(0, U64)
    m = len(h) - width + 1
    out = h[:m].copy()
    for j in range(1, width):
        out *= U64(0xA0761D6478BD642F)
        out += h[j : j + m]
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the word array where a full window of one text starts, and the text of each."""
    per = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    return at, doc


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, with the length at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


# ------------------------------------------------------------------------------------------ components
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Each round sends a node's smallest label to its neighbours and then follows the label's own label, so
    the number of rounds grows with the logarithm of a path's length.  Rounds end with a table in the shared
    folder; only one count comes to the driver.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both = materialise(both.union(both.select("v", "u")).distinct(), "edges")
    label = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")), "label0")
    k = 0
    while True:
        k += 1
        sent = both.join(label, both.u == label.node).select(F.col("v").alias("node"), "component")
        best = sent.union(label.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
        jump = best.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = materialise(best.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")), f"label{k}")
        changed = new.alias("n").join(label.alias("o"), "node").filter(F.col("n.component") != F.col("o.component")).limit(1).count()
        discard(label)
        label = new
        if not changed:
            return label


def spread_join(rows: DataFrame, side: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row a key, null keys aside); a key may have any share of the rows.

    A key with a ``share``-th of the rows or more is hot.  There can be ``share`` of them at most, so what ``side`` has for
    them is broadcast and their rows stay where they are; the others go by shuffle.  ``rows`` is read three times.
    """
    n = rows.count()
    hot = materialise(rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") * share >= n) & (F.col("_n") > share)).select(key), "hot")
    if hot.isEmpty():
        return rows.join(side, key, "left")
    few = materialise(side.join(F.broadcast(hot), key, "left_semi"), "hot_side")
    apart = rows.join(F.broadcast(hot), key, "left_anti").join(side, key, "left")
    return rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left").unionByName(apart)


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy(key).applyInArrow(fn, schema)
