"""Packing by minimum bin slack.

A text's ids are cut into pieces of the capacity and one remainder.  Full pieces are sequences of their own.
Remainders are packed from the histogram of their lengths (fewer numbers than the capacity, whatever the corpus):
the longest remaining length opens a sequence, a subset-sum bitset over the remaining multiset finds the fill
closest to the capacity, and backtracking gives the counts of each length.  That pattern is repeated while the
counts last.  A piece then finds its sequence from its rank within its length: ranks come from the piece's
task and a running sum over tasks, so no length's pieces meet in one place.

Null and empty texts have the end id alone.  Rows that share an id, and rows with a null id, are packed as texts of
their own.  A text of any length is cut, whole, into pieces of the capacity.  Empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048


def minimum_slack(left: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of each length of the multiset ``left`` that fill a sequence best, its longest length included."""
    seed = max(left)
    room, steps, bits = capacity - seed, [], 1
    mask = (1 << room + 1) - 1
    for size in sorted((s for s in left if s <= room), reverse=True):
        have, take = min(left[size] - (size == seed), room // size), 1
        while have > 0:
            take = min(take, have)
            steps.append((size, take, bits))
            bits |= bits << size * take & mask
            have -= take
            take *= 2
        if bits >> room & 1:
            break
    best, used = bits.bit_length() - 1, {seed: 1}
    for size, take, before in reversed(steps):
        if not before >> best & 1:
            best -= size * take
            used[size] = used.get(size, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int, first: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, rank from, rank to, first sequence, of this length in each, offset of the first)``."""
    left = {k: v for k, v in histogram.items() if v}
    ranks, rows, sequence = dict.fromkeys(left, 0), [], first
    while left:
        used = minimum_slack(left, capacity)
        times, offset = min(left[s] // k for s, k in used.items()), 0
        for size in sorted(used, reverse=True):
            k = used[size]
            rows.append((size, ranks[size], ranks[size] + k * times, sequence, k, offset))
            ranks[size] += k * times
            left[size] -= k * times
            offset += k * size
            if not left[size]:
                del left[size]
        sequence += times
    return rows


_PIECE = "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long, part int, slot long"


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in C.blocks(batches, limit=2 << 20):
            ids, off = enc.encode(b.column(1), end)
            total = np.diff(off)
            per = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
            length = np.minimum(capacity, total[doc] - start)
            order = np.argsort(length, kind="stable")
            at = C.runs(length[order])
            slot = np.empty(len(doc), np.int64)
            slot[order] = np.arange(len(doc)) - np.repeat(at[:-1], np.diff(at)) + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            begin = off[doc] + start
            raw = ids.astype("<u4").tobytes()
            cut = [raw[4 * x : 4 * y] for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(cut, pa.binary()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(total[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(slot)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "slot"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset`` for each piece.

    ``ids`` are little-endian unsigned 32-bit integers; ``ids_crc32`` is their checksum.
    """
    spark = C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = C.materialise(own.mapInArrow(C.lean(_pieces(tokenizer, end, capacity), holds=True), _PIECE), "pieces")
    counts = C.materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows come to the driver
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    rows = plan(histogram, capacity, full) + ([(capacity, 0, full, 0, 1, 0)] if full else [])
    # its size depends on the capacity alone: a pattern ends when a length runs out
    where = spark.createDataFrame(rows, "length int, lo long, hi long, first long, each long, at long")
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    # as many rows as tasks and lengths together: never broadcast
    rank = pieces.join(base.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("slot") + F.col("base"))
    placed = rank.join(F.broadcast(where), (rank.length == where.length) & (rank.rank >= where.lo) & (rank.rank < where.hi)).drop(where.length)
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    from .tokens import tokenizer_path

    return pack(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")
