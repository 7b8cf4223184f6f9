"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are scaled to unit length and turned by a random rotation, so that any block of columns is a random
sample of a distance.  Spherical k-means on a bounded sample (``SAMPLE`` rows with the smallest hash of the id)
gives the lists, ``PER_ROOT`` times the square root of the number of rows (an eighth of the sample at most); every
row is indexed, in the two lists that are nearest to it.  How much of the index a query probes, from its nearest list
on, is fitted too: the share at which ``TARGET`` of the sample's own true neighbours are within reach.

A first pass over the nearest lists (``NEAR`` of the share) scores all rows and fixes each query's ``k``-th best.  The
second pass carries this bound through the other lists: distances grow one block of ``COLUMNS`` columns at a time, and
after each a hypothesis test abandons the candidates that can't be as near as the bound.  Of a distance, the
share that falls on c of d random columns is Beta(c/2, (d - c)/2) distributed; a candidate goes if its partial distance
is above the bound's 1 - ``RISK`` quantile.  What survives is scored exactly, in double precision, on the
original vectors.

Rows and queries travel as packed blocks, sorted by list.  A list is cut into parts of about ``PART_ROWS`` rows; a task
holds one part and reads the queries that probe it block by block.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose number of
components isn't the most frequent one (ties: the smaller), nor rows with a null id.  Rows that share an id are
candidates each, but never for a query with that id; a query id gives its answers once.  With fewer than ``k``
candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 20_000
PER_ROOT = 4
TARGET = 0.97
NEAR = 0.1
COLUMNS = 16
RISK = 0.002
BLOCK_ROWS = 4096
PART_ROWS = 1 << 15
#: Rows of a list are dealt to so many salts, of which one or more make a part.
SALTS = 64
CELLS = 1 << 22


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: what takes part, as doubles, all of the same length."""
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.filter(fine)
    top = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return own.filter(F.size("v") == (top[0].d if top else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def beta_quantile(a: float, b: float, p: float) -> float:
    """The Beta distribution's quantile, by the trapezoidal rule."""
    t = np.linspace(0, 1, 20_001)[1:-1]
    mass = np.cumsum(np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t)))
    return float(np.interp(p * mass[-1], mass, t))


class Index:
    """Rotation, list centres and the share of the index that a query probes."""

    def __init__(self, sample: np.ndarray, lists: int, k: int) -> None:
        d = sample.shape[1]
        rng = np.random.default_rng(7)
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = unit(sample) @ self.rotation
        n = max(1, min(lists, len(x) // 8))
        self.centres = x[np.sort(rng.choice(len(x), n, replace=False))]
        for _ in range(8):
            of = (x @ self.centres.T).argmax(1)
            order = np.argsort(of, kind="stable")
            at = C.runs(of[order])[:-1]
            self.centres[of[order][at]] = np.add.reduceat(x[order], at)
            norm = np.sqrt((self.centres**2).sum(1, keepdims=True))
            self.centres = self.centres / np.where(norm > 0, norm, 1)
        self.share = self._fit(x, rng.choice(len(x), min(len(x), 256), replace=False), k)

    def _fit(self, x: np.ndarray, queries: np.ndarray, k: int) -> float:
        """The share of the sample's index before which ``TARGET`` of true neighbours stand."""
        lists = self.nearest(x)
        size = np.bincount(lists.ravel(), minlength=len(self.centres))
        near = x[queries] @ x.T
        near[np.arange(len(queries)), queries] = -2
        true = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
        if not true.size:
            return 1.0
        order = np.argsort(-(x[queries] @ self.centres.T), axis=1)
        before = np.empty(order.shape)
        np.put_along_axis(before, order, np.cumsum(size[order], axis=1) - size[order], 1)
        reach = np.take_along_axis(before, lists[true].reshape(len(queries), -1), 1).reshape(*true.shape, -1).min(2)
        return float(np.quantile(reach, TARGET) + 1) / lists.size

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """For each of the rotated unit vectors its two nearest lists (one if there is no second)."""
        near = x @ self.centres.T
        return np.argpartition(-near, 1, axis=1)[:, :2] if len(self.centres) > 2 else np.argsort(-near, axis=1)


_BLOCK = "list int, salt int, query boolean, n long, ids binary, rows binary, vectors binary, bounds binary"
_KINDS = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_FOUND = "query_id long, vec_id long, row long, score double"


def _table(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            b = batch.slice(at, rows)
            yield np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64), _matrix(b.column(1)), b


def _packed(lists: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(lists, kind="stable")
    cut = C.runs(lists[order])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(lists[order[a]]), order[a:b]


def _index(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for k, (ids, x, _) in enumerate(_sliced(batches, BLOCK_ROWS)):
            two = index.nearest(unit(x) @ index.rotation)
            row, of = np.divmod(np.arange(two.size), two.shape[1])
            keys = (part << 40) + seen + np.arange(len(ids))
            seen += len(ids)
            yield _table([(j, (part + k) % SALTS, False, len(at), ids[row[at]].tobytes(), keys[row[at]].tobytes(), x[row[at]].tobytes(), None) for j, at in _packed(two[row, of])], _KINDS, _BLOCK)

    return run


def _probe(index: Index, sizes: np.ndarray, near: bool):
    """A query's lists, up to ``NEAR`` of its share of the index or beyond it."""
    least, most = (0, index.share * NEAR) if near else (index.share * NEAR, index.share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, b in _sliced(batches, BLOCK_ROWS):
            order = np.argsort(-(unit(x) @ index.rotation @ index.centres.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            q, place = np.nonzero((before < most * sizes.sum()) & (before >= least * sizes.sum()))
            bounds = np.full(len(ids), np.inf) if near else b.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield _table([(j, 0, True, len(at), ids[q[at]].tobytes(), None, x[q[at]].tobytes(), bounds[q[at]].tobytes()) for j, at in _packed(order[q, place])], _KINDS, _BLOCK)

    return run


class Part:
    """A part of a list, ready for queries."""

    def __init__(self, index: Index, rows: list[dict]) -> None:
        self.index, self.d = index, index.rotation.shape[0]
        self.ids, self.rows = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "rows"))
        self.unit = unit(np.concatenate([np.frombuffer(r["vectors"]) for r in rows]).reshape(-1, self.d))
        self.turned = self.unit @ index.rotation
        cuts = list(range(0, self.d, COLUMNS)) + [self.d]
        self.steps = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.quantile = [beta_quantile(end / 2, (self.d - end) / 2, 1 - RISK) if end < self.d else 1.0 for _, end in self.steps]

    def search(self, queries: list[dict], k: int) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in queries])
        own = unit(np.concatenate([np.frombuffer(r["vectors"]) for r in queries]).reshape(-1, self.d))
        bound = np.concatenate([np.frombuffer(r["bounds"]) for r in queries])
        step = max(1, CELLS // len(self.ids))
        for a in range(0, len(ids), step):
            yield from self._some(ids[a : a + step], own[a : a + step], bound[a : a + step], k)

    def _some(self, ids: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        q, x = np.nonzero(ids[:, None] != self.ids[None, :])
        if np.isfinite(bound).any():
            turned, part = own @ self.index.rotation, np.zeros(len(q))
            for (start, end), share in zip(self.steps, self.quantile, strict=True):
                b, c = turned[:, start:end], self.turned[:, start:end]
                if len(q) * 8 > len(ids) * len(self.ids):  # most are there: all at once
                    part += ((b * b).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * b @ c.T)[q, x]
                else:
                    diff = c[x] - b[q]
                    part += np.einsum("ij,ij->i", diff, diff)
                keep = part <= bound[q] * share + 1e-9
                q, x, part = q[keep], x[keep], part[keep]
        score = np.concatenate([np.einsum("ij,ij->i", self.unit[x[i : i + CELLS // 64]], own[q[i : i + CELLS // 64]]) for i in range(0, len(q), CELLS // 64)]) if len(q) else np.zeros(0)
        order = np.lexsort((self.rows[x], self.ids[x], -score, q))
        at = C.runs(q[order])
        order = order[np.arange(len(q)) - np.repeat(at[:-1], np.diff(at)) < k]
        q, x = q[order], x[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(self.ids[x]), pa.array(self.rows[x]), pa.array(score[order])], names=["query_id", "vec_id", "row", "score"])


def _scan(index: Index, k: int):
    """Blocks sorted by list and part, rows before queries: the best ``k`` of each block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, part, held, n = None, [], None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if (r["list"], r["part"]) != at:
                    if held:
                        yield from part.search(held, k)
                    at, rows, part, held, n = (r["list"], r["part"]), [], None, [], 0
                if not r["query"]:
                    rows.append(r)
                elif rows:
                    part = part or Part(index, rows)
                    held.append(r)
                    n += r["n"]
                    if n >= BLOCK_ROWS:
                        yield from part.search(held, k)
                        held, n = [], 0
        if held:
            yield from part.search(held, k)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, share: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row (``is_query`` on ``vec_id``) its nearest found."""
    spark = C.ship(vectors.sparkSession)
    own = usable(vectors, id_col, vector_col)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(_matrix(sample), lists or int(PER_ROOT * own.count() ** 0.5), k)
    index.share = share or index.share
    blocks = C.materialise(own.mapInArrow(_index(index), _BLOCK), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in blocks.groupBy("list").agg(F.sum("n").alias("n")).collect():  # a number for each list
        sizes[r.list] = r.n
    # as many rows as lists
    parts = F.broadcast(spark.createDataFrame([(j, int(min(SALTS, -(-n // PART_ROWS)))) for j, n in enumerate(sizes.tolist()) if n], "list int, parts int"))
    placed = blocks.join(parts, "list").withColumn("part", F.col("salt") % F.col("parts")).drop("parts")

    def scanned(queries: DataFrame, near: bool) -> DataFrame:
        asked = queries.mapInArrow(_probe(index, sizes, near), _BLOCK).join(parts, "list")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = placed.unionByName(asked).repartition(C.partitions(spark), "list", "part").sortWithinPartitions("list", "part", "query")
        return met.mapInArrow(_scan(index, k), _FOUND)

    def best(found: DataFrame) -> DataFrame:
        """A row that two lists hold counts once."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
        once = found.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    queries = own.filter(is_query)
    first = C.materialise(best(scanned(queries, True)).select("query_id", "vec_id", "row", "score", "rank"), "near")
    bound = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("bound"))
    bounded = queries.join(bound, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return best(first.drop("rank").unionByName(scanned(bounded, False))).select("query_id", "rank", "vec_id", "score")
