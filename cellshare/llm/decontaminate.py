"""Benchmark decontamination: pigeonhole edit matching.

A test item and a text match if some stretch of the text is within ``budget`` edits of the whole item, the budget
being a tenth of the item's length.  The item is cut into budget + 1 pieces: one of them then stands unchanged
in the stretch.  An automaton finds all exact piece hits in the whole texts.  A hit is verified with Myers'
bit-parallel distance, first for the two pieces that it's part of, then for four and so on to the whole item: of
n pieces together, n - 1 edits are allowed, and if a whole matches, one of its halves does.

Items and texts are compared with ASCII letters in lower case and each run of white space as one space.  Items
go in blocks of ``BLOCK_ITEM_BYTES``, so what a task holds doesn't grow with the benchmark.  Null and empty texts
and items match nothing; items shorter than ``LEAST`` characters are too short for an edit budget and match
exactly.  Rows that share an id are matched each for itself; a null id is reported as null.
Items with a null id are skipped, whatever their text: documents that hold one are neither reported nor removed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TENTH = 10
LEAST = 30
BLOCK_ITEM_BYTES = 4 << 20


def normal(text: str) -> str:
    return b" ".join(text.encode().lower().split()).decode()


def budget(item: str) -> int:
    return len(item) // TENTH if len(item) >= LEAST else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """Budget + 1 pieces that cover the item, with their places; lengths differ by one at most."""
    n = budget(item) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Pattern:
    """A string to look for by Myers' bit-parallel distance."""

    def __init__(self, pattern: str) -> None:
        self.size, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str, enough: int = 0) -> int:
        """Least number of edits between the pattern and any stretch of the text; ends once it is ``enough``."""
        m, get = self.size, self.masks.get
        full, top = (1 << m) - 1, 1 << m - 1
        plus, minus, score, best = full, 0, m, m
        for c in text:
            eq = get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        return best
            # a match may start anywhere: nothing is carried into the first row
            up, down = up << 1 & full, down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return best


def _above(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces from its pair up to all."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def split(a: int, b: int) -> None:
        if b - a > 1:
            split(a, (a + b) // 2)
            split((a + b) // 2, b)
            for i in range(a, b):
                out[i].append((a, b))

    split(0, n)
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.items, of = items, defaultdict(list)
        self.places: list[list[int]] = []
        self.nodes: dict[tuple[int, int, int], Pattern] = {}
        self.up = {}
        for k, (_, item) in enumerate(items):
            cut = pieces(item)
            self.places.append([at for at, _ in cut] + [len(item)])
            if len(cut) not in self.up:
                self.up[len(cut)] = _above(len(cut))
            for i, (_, piece) in enumerate(cut):
                of[piece].append((k, i))
        self.auto = ahocorasick.Automaton()
        for piece, where in of.items():
            self.auto.add_word(piece, (len(piece), where))
        if of:
            self.auto.make_automaton()

    def _node(self, k: int, a: int, b: int) -> Pattern:
        if (k, a, b) not in self.nodes:
            at = self.places[k]
            self.nodes[k, a, b] = Pattern(self.items[k][1][at[a] : at[b]])
        return self.nodes[k, a, b]

    def matches(self, text: str) -> list[tuple[int, int]]:
        """``(item id, edits)`` of each item that the text holds."""
        if not len(self.auto):
            return []
        best: dict[int, int] = {}
        seen: dict[int, tuple[int, int]] = {}
        for end, (size, where) in self.auto.iter(text):
            for k, piece in where:
                if best.get(k) == 0:
                    continue
                at = self.places[k]
                start = end - size + 1 - at[piece]
                if k in seen and seen[k][0] <= start <= seen[k][1]:
                    continue  # the stretch around it has been verified whole
                n, edits = len(at) - 1, 0
                for a, b in self.up[n][piece]:
                    limit, whole = b - a - 1, b - a == n
                    edits = self._node(k, a, b).distance(text[max(0, start + at[a] - limit) : start + at[b] + limit], 0 if whole else limit)
                    if edits > limit:
                        break
                else:
                    best[k] = min(edits, best.get(k, edits))
                    seen[k] = (start, start)
        return [(self.items[k][0], d) for k, d in best.items()]


def _match(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for b in C.blocks(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(i, k, d) for k, d in matcher.matches(normal(text))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        if item := normal(r.text):
            held.append((r.item_id, item))
            size += len(item)
            if size >= BLOCK_ITEM_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, edits`` for each text and item that match, edits being the least number found."""
    spark = C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int")
    for block in item_blocks(benchmark):
        out = out.unionByName(own.mapInArrow(C.lean(_match(block)), "doc_id long, item_id long, edits int"))
    return out


def _clean(items: list[tuple[int, str]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            keep = [not text or not matcher.matches(normal(text)) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    C.ship(docs.sparkSession)
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(C.lean(_clean(block, docs.columns.index(text_col))), docs.schema)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
