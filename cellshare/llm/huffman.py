"""Token-id files: canonical length-limited Huffman coding with bit-offset checkpoints.

Texts are dealt by ranges of their id and sorted, so part 0, 1, ... and the chunks of a part are in ascending id
order.  Global id counts give code lengths by package-merge (the longest code is bounded), the lengths give
the canonical code.  A chunk is one record of the file:

    part, chunk, start (ids of the part before it), ids and sizes of its texts, n ids, bit offsets of every
    ``STEP``-th id, payload (bits, most significant first)

and a second file holds ``(symbol, bits)``, sorted canonically.  A reader needs only the second file and the
records it wants: every stretch between two checkpoints decodes by itself, and all stretches of a record are
decoded side by side with one table look-up for each id.

Null and empty texts hold the end id alone; rows with a null id come first, under the
smallest number that an id can be, and are read back as null; rows that share an id keep all their
ids, each in its own text, in any order among themselves.  An empty table gives empty files.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

STEP = 1024
CHUNK = 2_000_000
TAIL = 8
#: Bytes of payload from which bit offsets take 64 bits.
WIDE = 1 << 29
#: The id of rows that have none.
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge by levels)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    w = counts[order].astype(np.int64)
    levels, row = [], w
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        row = both[at]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(levels):
        used = int(single[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths and codes, by length and then symbol."""
    order = np.lexsort((symbols, lengths))
    s, b = symbols[order], lengths[order]
    top = int(b[-1]) if len(b) else 0
    # a code read as a fraction of one: each is the sum of the shares before it
    share = np.left_shift(np.int64(1), top - b)
    codes = (np.cumsum(share) - share) >> (top - b)
    return s, b, codes


def pack_bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offset of each code and the packed bits; ``lengths`` in a small unsigned type."""
    end = np.cumsum(lengths, dtype=np.uint32 if len(lengths) < 1 << 26 else np.uint64)
    at = end - lengths
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    word = at >> at.dtype.type(5)
    # a word's codes side by side, the last one reaching into the next word
    value = codes << (np.uint64(64) - ((at & at.dtype.type(31)) + lengths).astype(np.uint64))
    first = C.runs(word)[:-1]
    if len(word):
        both = np.bitwise_or.reduceat(value, first)
        words[word[first]] |= both >> np.uint64(32)
        words[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
    return at, words.astype(">u4").tobytes()[: -(-total // 8) + TAIL]


class Table:
    """Decoding table: the next bits give the symbol and its length."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        s, b, _ = canonical(symbols, lengths)
        self.bits = int(b[-1]) if len(b) else 1
        share = np.left_shift(np.int64(1), self.bits - b)
        # one look-up gives both: the symbol above, the length in the low five bits
        self.entry = np.zeros(1 << self.bits, np.uint32 if not len(s) or s.max() < 1 << 27 else np.uint64)
        self.entry[: int(share.sum())] = np.repeat(s.astype(self.entry.dtype) << self.entry.dtype.type(5) | b.astype(self.entry.dtype), share)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        word = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        out = np.empty((STEP, len(checkpoints)), np.uint32)
        # bit offsets of a chunk of over half a gigabyte, as one very long text makes it, need 64 bits
        place = np.uint32 if len(payload) < WIDE else np.uint64
        at, last, down = checkpoints.astype(place), place(len(word) - 1), np.uint32(32 - self.bits)
        three, seven, five, low = place(3), place(7), self.entry.dtype.type(5), self.entry.dtype.type(31)
        for k in range(min(STEP, n)):
            entry = self.entry[word[np.minimum(at >> three, last)] << (at & seven).astype(np.uint32, copy=False) >> down]
            out[k] = entry >> five
            at += (entry & low).astype(place)
        return out.T.reshape(-1)[:n] if n >= STEP else out[:n, 0]


_CHUNK = "part int, chunk int, start long, doc_ids binary, sizes binary, n long, ids binary, seen binary"


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part = encoder(path), TaskContext.get().partitionId()
        chunk, start, held, size = 0, 0, [], 0

        def out() -> pa.RecordBatch:
            docs, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            wide = len(ids) and int(ids.max()) >= 1 << 16
            row = (part, chunk, start, docs.tobytes(), sizes.astype("<u4").tobytes(), len(ids), (b"4" if wide else b"2") + ids.astype("<u4" if wide else "<u2").tobytes())
            symbol, times = np.unique(ids, return_counts=True) if wide else ((c := np.bincount(ids)).nonzero()[0], c[c > 0])
            seen = np.stack([symbol, times], 1).astype("<i8").tobytes()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*row, seen), kinds, strict=True)], names=["part", "chunk", "start", "doc_ids", "sizes", "n", "ids", "seen"])

        for b in C.blocks(batches, limit=8 << 20):
            ids, off = enc.encode(b.column(1), end)
            held.append((b.column(0).to_numpy(zero_copy_only=False), np.diff(off), ids))
            size += len(ids)
            if size >= CHUNK:
                yield out()
                chunk, start, held, size = chunk + 1, start + size, [], 0
        if held:
            yield out()

    return run


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[:1] == b"4" else "<u2", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        for packed in b.column(0).to_pylist():
            pairs = np.frombuffer(packed, "<i8").reshape(-1, 2)
            total.update(dict(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["symbol", "n"])


_FILE = "part int, chunk int, start long, doc_ids binary, sizes binary, n long, checkpoints binary, payload binary"


def _encode(symbols: np.ndarray, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import forget

        forget()
        s, b, codes = canonical(symbols, lengths)
        code, size = np.zeros(int(s.max()) + 1, np.uint64), np.zeros(int(s.max()) + 1, np.uint8)
        code[s], size[s] = codes, b
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = _ids(row.column(6)[0].as_py())
                at, payload = pack_bits(code[ids], size[ids])
                yield pa.RecordBatch.from_arrays([*(row.column(k) for k in range(6)), pa.array([at[::STEP].astype("<i8").tobytes()], pa.binary()), pa.array([payload], pa.binary())], names=["part", "chunk", "start", "doc_ids", "sizes", "n", "checkpoints", "payload"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts in ascending id order and write ``path/data`` and ``path/code``."""
    spark = C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows without an id needn't be in one part
    own = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("place"))
    dealt = own.repartitionByRange(C.partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    chunks = C.materialise(dealt.mapInArrow(_tokenise(tokenizer, end), _CHUNK), "chunks", "uncompressed")
    del dealt
    C.release(spark, flush=True)
    # as many rows as the vocabulary has ids, at most
    counts = chunks.select("seen").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    symbols, n = counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    lengths = code_lengths(n, max(12, int(np.ceil(np.log2(max(len(n), 2)))) + 3)) if len(n) else n
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist(), strict=True)), "symbol long, bits int").coalesce(1).sort("bits", "symbol").write.parquet(f"{path}/code")
    coded = chunks.drop("seen").mapInArrow(_encode(symbols, lengths), _FILE) if len(n) else spark.createDataFrame([], _FILE)
    coded.write.option("compression", "none").parquet(f"{path}/data")


def _decode(symbols: np.ndarray, lengths: np.ndarray, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import forget

        forget()
        table = Table(symbols, lengths)
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids = table.decode(r["payload"], np.frombuffer(r["checkpoints"], "<i8"), r["n"]).astype("<u4")
                docs, sizes = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                off, raw = np.concatenate([[0], np.cumsum(sizes)]), ids.tobytes()
                each = [raw[4 * x : 4 * y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(off[:-1] + r["start"] + base[r["part"]]), pa.array(sizes), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``ids`` are little-endian unsigned 32-bit integers."""
    C.ship(spark)
    code = spark.read.parquet(f"{path}/code").toPandas()
    data = spark.read.parquet(f"{path}/data")
    # one number for each part of the files
    parts = sorted((r.part, r.n) for r in data.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(np.int64)
    base = {p: int(e) for (p, _), e in zip(parts, ends[:-1], strict=True)}
    run = _decode(code["symbol"].to_numpy(np.int64), code["bits"].to_numpy(np.int64), base)
    out = data.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
