"""Alignment of two tokenizers' tokens by segment deduplication.

A is a byte-level BPE file, B a piece model with byte fallback; both encode a text with a space in front.  Texts are cut
before white-space runs where neither vocabulary can merge across: A's words never hold white space after anything
else, and of the characters that may begin a run only those count before which no entry of either vocabulary
would be cut (``cuttable`` looks at every entry).  A block of texts becomes a list of its distinct segments and, for
each text, their numbers; distinct segments of all blocks are tokenised and aligned once, counts of linked id pairs
are summed over all occurrences, and each block gets its segments' alignments back and composes its texts.

Where an A and a B token both end, groups end.  Between two neighbouring token ends of either kind exactly one A and
one B token overlap: each such stretch is a link.  Segments end for both, so groups and links of a text are
those of its segments.

Null and empty texts have no tokens; nor have texts that B's own normal form doesn't give back.  Rows that share an id
are documents of their own, a null id stays null.  A text is never cut off, however long.  Empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Text of a block: the larger, the more of its segments are repeats.
BLOCK = 16 << 20
SALTS = 16
#: Bits of a block's number within its task, and of a segment's within its block.
_BLOCKS, _NUMBERS = 14, 28
SPACE_PIECE = "▁"
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


# --------------------------------------------------------------------------------------------- cutting
def _after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what stands before each place may be white space, beyond ASCII too."""
    x, y, z = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    two = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
    e1 = (z == 0xE1) & (((y == 0x9A) & (x == 0x80)) | ((y == 0xA0) & (x == 0x8E)))
    e2 = (z == 0xE2) & (((y == 0x80) & ((x <= 0x8F) | ((x >= 0xA8) & (x <= 0xAF)))) | ((y == 0x81) & (x >= 0x9F) & (x <= 0xAF)))
    return _BLANK[x] | two | e1 | e2 | ((z == 0xE3) & (y == 0x80) & (x == 0x80)) | ((z == 0xEF) & (y == 0xBB) & (x == 0xBF))


def cuts(data: np.ndarray, starters: np.ndarray) -> np.ndarray:
    """Places in the bytes where a white-space run begins with one of the starters, not at the first byte."""
    at = np.flatnonzero(starters[data[1:]] & ~_BLANK[data[:-1]]) + 1
    return at[~_after_blank(data, at)]


def cuttable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """By byte: whether it may begin a run that is cut off, as no entry of either vocabulary holds such a place."""
    ok = np.zeros(256, bool)
    ok[[9, 10, 13, 32]] = True
    for entries in (a, b):
        long = [e for e in entries if len(e) > 1]
        data = np.frombuffer(b"".join(b"x" + e for e in long), np.uint8)
        first = np.cumsum([0, *map(len, long)])[:-1] + np.arange(1, len(long) + 1)
        ok[data[np.setdiff1d(cuts(data, ok), first)]] = False
    # B is asked for runs that begin otherwise than with a space behind a space of its own, which mustn't merge with them
    ok[data[(data != 32) & _BLANK[data]]] = False
    return ok


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, what their tokens' bytes are, and where texts may be cut."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        code, plain = _byte_level(), self.a.get_vocab(with_added_tokens=False)
        a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
        for token, i in plain.items():
            a[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE_PIECE, " ").encode())
        self.starters = cuttable(a, b)
        self.space = self.b.piece_to_id(SPACE_PIECE)
        if self.b.is_unknown(self.space):
            self.starters[:] = False
        self.flat = [np.frombuffer(b"".join(x), np.uint8) for x in (a, b)]
        self.size = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        self.at = [np.cumsum(s) - s for s in self.size]

    def verbatim(self, segments: list[str]) -> np.ndarray:
        """Whether B's normal form of each segment is the segment, spaces written its way."""
        asked = [s[1:] if s[:1] == " " else s for s in segments]
        return np.fromiter((not s or (SPACE_PIECE not in s and n == SPACE_PIECE + s.replace(" ", SPACE_PIECE)) for n, s in zip(self.b.normalize(asked), asked, strict=True)), bool, len(asked))

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids and B's ids of segments that begin with a space or another starter."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[:1] == " " else s for s in segments])
        for k, s in enumerate(segments):
            if s == " ":
                b[k] = [self.space]
            elif s[:1] != " ":  # the space that B puts before it stays a piece of its own
                if b[k][:1] != [self.space]:
                    raise ValueError(f"a vocabulary merges across the beginning of {s[:20]!r}")
                b[k] = b[k][1:]
        return a, b

    def ends(self, which: int, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[which][ids])

    def bytes_of(self, which: int, ids: np.ndarray) -> np.ndarray:
        size = self.size[which][ids]
        return self.flat[which][np.arange(int(size.sum())) + np.repeat(self.at[which][ids] - (np.cumsum(size) - size), size)]


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in C.held:
        C.held.clear()
        C.held[paths] = Pair(*paths)
    return C.held[paths]


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the eighth for more; and where each number's bytes begin."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3, 4))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        live = size > k
        out[at[:-1][live] + k] = (numbers[live] >> 7 * k & 127) | np.where(size[live] > k + 1, 128, 0)
    return out, at


def _unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(data) else np.zeros(0, np.int64)


_DEALT = "block long, doc_id long, numbers binary, slot long, segment string, n long"


def _dealt(paths: tuple[str, str], limit: int):
    """Each block's texts as numbers, and its distinct segments with how often they occur in texts that have tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, part = _pair(paths), TaskContext.get().partitionId()
        for k, b in enumerate(_larger(C.blocks(batches, limit=limit), limit)):
            data, offs = C.utf8(b.column("text"))
            full = np.flatnonzero(np.diff(offs))
            data = np.insert(data, offs[full], 32)
            starts = offs[full] + np.arange(len(full))
            begins = np.zeros(len(data), bool)
            begins[starts] = True
            if len(full):
                begins[cuts(data, pair.starters)] = True
            at = np.flatnonzero(begins)
            segments = _strings(data, at)
            coded = segments.dictionary_encode()
            number, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            # texts with a segment that isn't given back have no tokens
            text = np.searchsorted(starts, at, "right") - 1
            bad = np.zeros(len(full), bool)
            bad[text[~pair.verbatim(distinct)[number]]] = True
            number, text = number[~bad[text]], text[~bad[text]]
            n = np.bincount(number, minlength=len(distinct))
            order = np.argsort(-n, kind="stable")  # the commonest have the shortest numbers
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n))
            raw, byte_at = _packed(rank[number])
            edge = byte_at[np.searchsorted(text, np.arange(len(full) + 1))]
            packed, whole = [b""] * b.num_rows, raw.tobytes()
            for j, row in enumerate(full.tolist()):
                packed[row] = whole[edge[j] : edge[j + 1]]
            used = order[: int((n > 0).sum())]
            if k >> _BLOCKS or len(used) >> _NUMBERS:
                raise OverflowError("too many blocks in a task, or segments in a block, to be numbered")
            block, rows, words = part << _BLOCKS | k, b.num_rows, len(used)
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), b.column("doc_id"), pa.array(packed, pa.binary()), none(pa.int64(), rows), none(pa.string(), rows), none(pa.int64(), rows)], names=_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(words, block)), none(pa.int64(), words), none(pa.binary(), words), pa.array((block << _NUMBERS) + np.arange(words)), coded.dictionary.take(pa.array(used)).cast(pa.string()), pa.array(n[used])], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _DEALT.split(", ")]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _larger(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# -------------------------------------------------------------------------------------------- alignment
_ALIGNED = "segment string, n long, packed binary, a array<int>, b array<int>"


def _aligned(paths: tuple[str, str]):
    """Groups and links (``a[k]`` with ``b[k]``) of each distinct segment.

    A group is packed as the numbers of its A and B ids and then these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in C.blocks(batches, "segment", 1 << 20):
            if not batch.num_rows:
                continue
            data, offs = C.utf8(batch.column("segment"))
            lists = pair.ids(batch.column("segment").to_pylist())
            ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in lists]
            ends, marks = [], np.zeros((2, len(data) + 1), bool)
            for which in (0, 1):
                if not np.array_equal(pair.bytes_of(which, ids[which]), data):
                    raise ValueError("tokens of a segment don't give it back")
                ends.append(pair.ends(which, ids[which]))
                marks[which, ends[which]] = True
            every, common = np.flatnonzero(marks.any(0)), np.flatnonzero(marks.all(0))
            linked = [ids[which][np.searchsorted(ends[which], every)] for which in (0, 1)]
            link_at, group_at = (np.append(0, np.searchsorted(x, offs[1:], "right")) for x in (every, common))
            group = [np.searchsorted(common, e) for e in ends]
            first = [np.searchsorted(g, np.arange(len(common) + 1)) for g in group]
            p, q = np.diff(first[0]), np.diff(first[1])
            base = np.append(0, np.cumsum(2 + p + q))
            row = np.empty(base[-1], np.int64)
            row[base[:-1]], row[base[:-1] + 1] = p, q
            for which, before in ((0, 0), (1, p)):
                at = base[:-1] + 2 + before - first[which][:-1]
                row[at[group[which]] + np.arange(len(ids[which]))] = ids[which]
            raw, byte_at = _packed(row)
            cut = byte_at[base[group_at]].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cut), pa.py_buffer(raw)])
            lists_of = lambda v: pa.ListArray.from_arrays(pa.array(link_at.astype(np.int32)), pa.array(v.astype(np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("n"), packed, lists_of(linked[0]), lists_of(linked[1])], names=["segment", "n", "packed", "a", "b"])

    return run


_COMPOSED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


_ANSWER = "block long, raw binary"


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes to one block from here, as one compressed string: numbers, sums, sizes and packed groups side by side."""
    press = zstandard.ZstdCompressor(level=3)
    for b in _larger(batches, 16 << 20):
        slot = b.column("slot").to_numpy()
        order = np.argsort(slot)
        slot = slot[order]
        data, offs = C.utf8(b.column("packed").take(pa.array(order)))
        sums = [b.column(c).to_numpy()[order] for c in ("n_best", "count_sum")]
        at, out = C.runs(slot >> _NUMBERS), []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            numbers = np.stack([slot[x:y] & (1 << _NUMBERS) - 1, np.diff(offs[x : y + 1]), *(s[x:y] for s in sums)]).astype("<i8")
            out.append(press.compress(np.int64(y - x).tobytes() + numbers.tobytes() + data[offs[x] : offs[y]].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(slot[at[:-1]] >> _NUMBERS), pa.array(out, pa.binary())], names=["block", "raw"])


def _unbundled(rows: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """``number, size, n_best, count_sum`` by number, and the packed groups."""
    numbers, packed = [np.zeros((4, 0), np.int64)], []
    for raw in rows:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        numbers.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n))
        end = 8 + 32 * n + np.append(0, np.cumsum(numbers[-1][1]))
        packed += [raw[x:y] for x, y in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
    every = np.concatenate(numbers, 1)
    order = np.argsort(every[0])
    return every[:, order], [packed[k] for k in order.tolist()]


def _written(packed: list[bytes]) -> Iterator[tuple[str, int, int, int]]:
    """Each segment's groups as text, and how many A ids, B ids and groups it has."""
    for i in range(0, len(packed), 1 << 16):
        some = packed[i : i + (1 << 16)]
        raw = b"".join(some)
        ends = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) < 128))[np.cumsum([0, *map(len, some)])].tolist()
        numbers = _unpacked(raw).tolist()
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            groups, n_a, n_b = [], 0, 0
            while x < y:
                p, q = numbers[x], numbers[x + 1]
                z, x = x + 2 + p, x + 2 + p + q
                groups.append(f"{numbers[z - 1]}|{numbers[z]}" if p == q == 1 else f"{','.join(map(str, numbers[z - p : z]))}|{','.join(map(str, numbers[z:x]))}")
                n_a, n_b = n_a + p, n_b + q
            yield ";".join(groups), n_a, n_b, len(groups)


def _composed(whole: bool):
    """Texts of one block from its segments' alignments."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        (_, _, n_best, count_sum), packed = _unbundled(answers.column("raw").to_pylist())
        groups, per = [], np.zeros((len(packed), 3), np.int64)
        for k, (text, *counts) in enumerate(_written(packed)):
            groups.append(text)
            per[k] = counts
        n_a, n_b, n_groups = per.T
        # each token end but the first begins a link, and where both end, one link begins for two tokens
        table = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum], 1)
        sums, texts = np.zeros((docs.num_rows, 6), np.int64), []
        for k, raw in enumerate(docs.column("numbers").to_pylist()):
            numbers = _unpacked(raw)
            sums[k] = table[numbers].sum(0)
            own = ";".join(map(groups.__getitem__, numbers.tolist()))
            texts.append(own if whole or not own else hashlib.sha256(own.encode()).hexdigest())
        return pa.table([docs.column("doc_id"), *[pa.array(s) for s in sums.T], pa.array(texts, pa.string())], names=[c.split()[0] for c in _COMPOSED.split(", ")])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, whole: bool = False, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    With ``whole``, the last column has the groups themselves.  ``n_best``: links whose pair's count is the highest of its B id.
    """
    C.ship(docs.sparkSession)
    paths = (a_path, b_path)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = C.materialise(own.mapInArrow(C.lean(_dealt(paths, block), holds=True), _DEALT), "dealt")
    texts, parts = dealt.filter("numbers is not null").select("block", "doc_id", "numbers"), dealt.filter("segment is not null").select("slot", "segment", "n")
    distinct = parts.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = C.materialise(distinct.mapInArrow(C.lean(_aligned(paths), holds=True), _ALIGNED).withColumn("id", F.monotonically_increasing_id()), "aligned")
    C.release(docs.sparkSession, flush=True)
    pairs = aligned.select("id", "n", F.explode(F.arrays_zip("a", "b")).alias("p")).select("id", "n", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    count = C.materialise(count, "pairs")
    best = count.groupBy("b").agg(F.max("count").alias("best"))
    # at most the product of the vocabularies, in fact some for each id of B; a pair may stand in any share of the segments
    scored = count.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.select("id", "a", "b", F.pmod("id", F.lit(SALTS)).cast("int").alias("salt"))
    summed = salted.join(scored, ["a", "b", "salt"]).groupBy("id").agg(F.sum("is_best").alias("n_best"), F.sum("count").alias("count_sum"))
    done = C.materialise(aligned.select("id", "segment", "packed").join(summed, "id").drop("id"), "scored")
    C.discard(aligned, count)
    C.release(docs.sparkSession, flush=True)
    # of a segment a block has one row at most, so the commonest have as many rows as there are blocks
    back = parts.select("slot", "segment").join(done, "segment").select("slot", "packed", "n_best", "count_sum").mapInArrow(C.lean(_bundled), _ANSWER)
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_composed(whole), _COMPOSED)
