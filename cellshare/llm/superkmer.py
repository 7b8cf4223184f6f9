"""Substring dedup: super-k-mer partitioning of word windows.

A window is ``width`` consecutive words of one text.  Its minimiser is the first of its runs of ``MINI`` neighbouring
words, ordered by length, longest first, and then by hash: short words are the common ones, and a minimiser that
most texts have would gather their windows in one bucket.  Consecutive windows with the same minimiser travel as one packed string (a slice
of the text) to the minimiser's bucket.  The bucket sorts the windows, so that equal ones stand together, and
finds the smallest document that starts each.  A window that also starts in a smaller document is repeated;
the words it covers are removed.

A block first sorts its own windows: what a smaller document of the same block repeats is settled there, and
only the smallest document's copy travels.  So a bucket gets a window once from each block at most, however many
documents hold it.  Equality is that of a 64-bit window hash and the minimiser (its length and 58 bits) together.

Null and empty texts have no words and nothing is removed; a text shorter than a window keeps all words; a
repeat inside one document alone is kept.  Rows that share an id count as one document for the order, and
each has its own text's words removed.  A null id takes no part in the search and keeps its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MINI = 2
BUCKETS_PER_PARTITION = 4
_SENT = "bucket int, ids binary, texts binary, starts binary, counts binary, packed binary"
_NAMES = ["bucket", "ids", "texts", "starts", "counts", "packed"]


def minimisers(h: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The first of the runs of ``MINI`` words in each run of ``width``: ``size`` are the words' lengths, ``h`` their hashes."""
    low, span, want = C.rolling(h, MINI), 1, width - MINI + 1
    length = sum(size[j : len(size) - MINI + 1 + j] for j in range(MINI))
    low = (63 - np.minimum(length, 63)).astype(C.U64) << C.U64(58) | low >> C.U64(6)
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (want - span)], low[want - span :]) if want > span else low


def _smallest(keys: np.ndarray, minis: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the smallest id among equal windows."""
    order = np.argsort(keys)
    at = C.runs(keys[order])
    m = minis[order]
    if len(keys) and (np.minimum.reduceat(m, at[:-1]) != np.maximum.reduceat(m, at[:-1])).any():
        order = np.lexsort((minis, keys))
        k, m = keys[order], minis[order]
        at = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1, [len(k)]])
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], at[:-1]), np.diff(at))
    return out


def _stretches(flag: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of flagged neighbours; ``same[i]`` ties i to i-1."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = flag.copy()
    new[1:] &= ~(flag[:-1] & same[1:])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return first, np.bincount(group[flag], minlength=len(first)) if len(first) else np.zeros(0, np.int64)


def _pack(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        block = 0
        for b in C.blocks(batches):
            block += 1
            ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            texts = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
            data, offs = C.utf8(b.column(2))
            s, e, first = C.word_spans(data, offs)
            h = C.word_hashes(data, s, e)
            at, doc = C.window_starts(first, width)
            if not len(at):
                continue
            keys, minis = C.rolling(h, width)[at], minimisers(h, e - s, width)[at]
            repeated = ids[doc] > _smallest(keys, minis, ids[doc])
            same = np.zeros(len(at), bool)
            same[1:] = doc[1:] == doc[:-1]
            out = []
            i, c = _stretches(repeated, same)
            if len(i):
                out.append((block % buckets, ids[doc[i]].tobytes(), texts[doc[i]].tobytes(), (at[i] - first[doc[i]]).astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), None))
            same[1:] &= minis[1:] == minis[:-1]
            i, c = _stretches(~repeated, same)
            to = C.bucket_of(C.mix(minis[i]), buckets)
            order = np.argsort(to, kind="stable")
            i, c, to = i[order], c[order], to[order]
            begin, end = s[at[i]].tolist(), e[at[i] + c + (width - 2)].tolist()
            raw = data.tobytes()
            cut = C.runs(to)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                k = i[x:y]
                packed = press.compress(b" ".join([raw[p:q] for p, q in zip(begin[x:y], end[x:y], strict=True)]))
                out.append((int(to[x]), ids[doc[k]].tobytes(), texts[doc[k]].tobytes(), (at[k] - first[doc[k]]).astype(np.int32).tobytes(), c[x:y].astype(np.int32).tobytes(), packed))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(col, pa.binary()) for col in cols[1:])], names=_NAMES)

    return run


def _found(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: the word spans to remove, packed for each text."""
        rows = table.to_pylist()
        get = lambda rs, k, t: np.concatenate([np.frombuffer(r[k], t) for r in rs]) if rs else np.zeros(0, t)
        done, rows = [r for r in rows if r["packed"] is None], [r for r in rows if r["packed"] is not None]
        ids, texts, start, count = (get(done, k, t) for k, t in (("ids", np.int64), ("texts", np.int64), ("starts", np.int32), ("counts", np.int32)))
        if rows:
            own, text, begin, n = (get(rows, k, t) for k, t in (("ids", np.int64), ("texts", np.int64), ("starts", np.int32), ("counts", np.int32)))
            undo = zstandard.ZstdDecompressor()
            data = np.frombuffer(b" ".join([undo.decompress(r["packed"]) for r in rows]), np.uint8)
            s, e, _ = C.word_spans(data, np.array([0, len(data)]))
            h = C.word_hashes(data, s, e)
            first = np.concatenate([[0], np.cumsum(n.astype(np.int64) + (width - 1))])
            at, piece = C.window_starts(first, width)
            keys, minis = C.rolling(h, width)[at], minimisers(h, e - s, width)[at]
            repeated = own[piece] > _smallest(keys, minis, own[piece])
            same = np.zeros(len(at), bool)
            same[1:] = piece[1:] == piece[:-1]
            i, c = _stretches(repeated, same)
            k = piece[i]
            ids, texts, count = np.concatenate([ids, own[k]]), np.concatenate([texts, text[k]]), np.concatenate([count, c])
            start = np.concatenate([start, begin[k] + (at[i] - first[k])])
        order = np.lexsort((texts, ids))
        ids, texts = ids[order], texts[order]
        spans = np.stack([start[order], start[order] + count[order] + (width - 1)], 1).astype(np.int32)
        cut = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
        packed = [spans[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(ids[cut[:-1]]), pa.array(texts[cut[:-1]]), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "spans"])

    return run


def repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, spans``: word spans that windows of smaller documents cover, packed as pairs of 32-bit ints."""
    spark = C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    own = own.filter("doc_id is not null and text is not null")
    sent = own.mapInArrow(_pack(width, BUCKETS_PER_PARTITION * C.partitions(spark)), _SENT)
    return C.grouped(sent, "bucket", _found(width), "doc_id long, text_key long, spans binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.blocks(batches):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        kept, total, gone = [], [], []
        for text, spans in zip(texts, b.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            total.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, np.int32)
                for packed in spans:
                    pairs = np.frombuffer(packed, np.int32).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = list(compress(words, keep.tolist()))
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])


def dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept, n_words, n_removed`` for every row: the text without repeated words, joined by one space."""
    # written, so that the packed strings' shuffle files can go before the texts move
    found = C.materialise(repeats(docs, width, id_col, text_col), "spans").groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))
    C.release(docs.sparkSession, flush=True)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    both = own.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, kept string, n_words long, n_removed long")
