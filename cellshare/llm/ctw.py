"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; a decision's contexts are the bits of the byte so far together with the last
0, 1, ... ``DEPTH`` bytes (a text starts after a run of zero bytes, letters A-Z in lower case).  Every context node
holds counts and their Krichevsky-Trofimov block probability; a node's weighted probability is half that and half
the product of its children's.  The predictive probability mixes the nodes' estimates along the path with the
posterior weights that follow, and stops where training never went.  A text ends with the byte 255, which UTF-8 never
has, so that the probabilities of all texts add up to one.  The sum of logarithms over a text and its end is its
score, and gives the code length per byte (of the text; null where it is empty).

All of it is counts, so it distributes:

1. Texts are dealt to blocks by a hash of the id.  A block's distinct (context, byte) strings, ``DEPTH`` + 1 bytes in
   a 64-bit number, go to the bucket of their last two context bytes, packed, with their training counts.
2. A bucket adds them up.  Whole subtrees below two context bytes lie in one bucket; what it passes up are the
   logarithms that the nodes of one context byte need, at most 65,280 numbers.
3. With the top of the tree known, a bucket gives each block the logarithm of every string that it asked for.
4. A block adds them up along its texts.

The word model for comparison goes the same way: distinct words and their training counts to buckets, totals
back.  Nothing that grows with the corpus is broadcast or collected.

Null and empty texts have the end token and the end byte alone.  Rows with a null id are scored, belong to no fold
and aren't learned from.  Rows that share an id are learned from and scored each for itself.  Without training
texts every decision has probability one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 6
CHUNK_BYTES = 1 << 20
#: A bucket's share of the tree is in a worker's memory.
BUCKETS_PER_PARTITION = 2
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
END = np.uint64(0x9D39247E33776D41)  # the end token's place among the word hashes
END_BYTE = 255


# ------------------------------------------------------------------------------------------- estimates
def _log_gamma_half(n: int) -> np.ndarray:
    """log Γ(k + 1/2) - log Γ(1/2) for k = 0 ... n."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n) + 0.5))])


def _log_half(k: np.ndarray) -> np.ndarray:
    """The same for any counts, by Stirling's series where they are large."""
    small = np.minimum(k, 255)
    out = _log_gamma_half(256)[small]
    big = k > 255
    if big.any():
        x = k[big] + 0.5
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return out


def _log_factorial(k: np.ndarray) -> np.ndarray:
    small = np.minimum(k, 255)
    out = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])[small]
    big = k > 255
    if big.any():
        x = k[big] + 1.0
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    return _log_half(zeros) + _log_half(ones) - _log_factorial(zeros + ones)


class Level:
    """Nodes of one depth: sorted keys (context bytes, then the byte's bits after a leading one), and counts."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> None:
        byte = byte.astype(np.int64)
        nodes, zero, one = [], [], []
        for bit in range(8):
            prefix = (byte >> (8 - bit)) | (1 << bit)
            nodes.append(context << np.uint64(8) | prefix.astype(np.uint64))
            set_ = byte >> (7 - bit) & 1
            zero.append(count * (1 - set_))
            one.append(count * set_)
        keys = np.concatenate(nodes)
        order = np.argsort(keys)
        at = C.runs(keys[order])[:-1]
        self.keys = keys[order][at] if len(keys) else keys
        self.zeros = np.add.reduceat(np.concatenate(zero)[order], at) if len(keys) else np.zeros(0, np.int64)
        self.ones = np.add.reduceat(np.concatenate(one)[order], at) if len(keys) else np.zeros(0, np.int64)
        self.estimate = block_probability(self.zeros, self.ones)
        self.below: np.ndarray | None = None

    def weigh(self, below: np.ndarray | None) -> None:
        """``below``: the sum of the children's logarithms, none at the greatest depth."""
        self.below = below
        if below is None:
            self.weighted, self.stay = self.estimate, np.ones(len(self.keys))
        else:
            top = np.logaddexp(self.estimate, below)
            self.weighted, self.stay = top - np.log(2), np.exp(self.estimate - top)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """A node's key without its oldest context byte."""
    return keys & np.uint64((1 << 8 * depth) - 1)  # 8 bits of the byte's prefix and depth - 1 context bytes


def grow(grams: np.ndarray, counts: np.ndarray, low: int, depth: int) -> dict[int, Level]:
    """Levels ``low`` ... ``depth`` of the tree over training strings, weighted upwards as far as they go."""
    levels = {}
    context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
    for d in range(low, depth + 1):
        levels[d] = Level(context & np.uint64((1 << 8 * d) - 1), byte, counts)
    levels[depth].weigh(None)
    for d in range(depth - 1, low - 1, -1):
        levels[d].weigh(collected(levels[d], levels[d + 1], d + 1))
    return levels


def collected(level: Level, children: Level, depth: int) -> np.ndarray:
    at, _ = level.find(parent(children.keys, depth))
    return np.bincount(at, children.weighted, minlength=len(level.keys))


def predict(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 probability of each string's last byte after the others."""
    out = np.zeros(len(grams))
    context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        prefix = ((byte >> (8 - bit)) | (1 << bit)).astype(np.uint64)
        one = (byte >> (7 - bit) & 1).astype(bool)
        total, left, last = np.zeros(len(grams)), np.ones(len(grams)), np.full(len(grams), 0.5)
        open_ = np.ones(len(grams), bool)
        for d in sorted(levels):
            lv = levels[d]
            at, there = lv.find((context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | prefix)
            open_ &= there
            if not open_.any():
                break
            k = at[open_]
            n = np.where(one[open_], lv.ones[k], lv.zeros[k])
            p = (n + 0.5) / (lv.zeros[k] + lv.ones[k] + 1)
            total[open_] += left[open_] * lv.stay[k] * p
            left[open_] *= 1 - lv.stay[k]
            last[open_] = p
        # where the tree ends before the mixture does, the deepest estimate has the rest
        out += np.log10(total + left * last)
    return out


# ----------------------------------------------------------------------------------------------- blocks
def _strings(data: np.ndarray, offs: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of the texts, it and the ``depth`` bytes before it as one number."""
    out = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for j in range(1, depth + 1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j] if j < len(data) else 0
        before[place < j] = 0
        out |= before << np.uint64(8 * j)
    return out


def _ended(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their end bytes."""
    return np.insert(data, offs[1:], END_BYTE), offs + np.arange(len(offs))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, bytes (lower case) and offsets, about ``CHUNK_BYTES`` at a time."""
    data, offs = C.utf8(texts)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, C.lower_ascii(data[offs[at] : offs[to]]), offs[at : to + 1] - offs[at]
        at = to


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    at = C.runs(k[order])[:-1]
    return (k[order][at], np.add.reduceat(c[order], at)) if len(k) else (k, c)


def _distinct(values: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    at = C.runs(values[order])[:-1]
    return (values[order][at], np.add.reduceat(learned[order].astype(np.int64), at)) if len(values) else (values, np.zeros(0, np.int64))


def _inventory(texts: pa.Array, learned: np.ndarray, depth: int):
    """The block's distinct strings and words with their training counts, both sorted."""
    found: dict[str, tuple[list, list]] = {"gram": ([], []), "word": ([], [])}
    for a, b, data, offs in _chunks(texts):
        s, e, first = C.word_spans(data, offs)
        ended, ends = _ended(data, offs)
        for kind, values, mask in (("gram", _strings(ended, ends, depth), np.repeat(learned[a:b], np.diff(ends))), ("word", C.word_hashes(data, s, e), np.repeat(learned[a:b], np.diff(first)))):
            k, c = _distinct(values, mask)
            found[kind][0].append(k)
            found[kind][1].append(c)
            if len(found[kind][0]) > 8:
                k, c = _sum(*found[kind])
                found[kind] = ([k], [c])
    grams, words = _sum(*found["gram"]), _sum(*found["word"])
    ends = int(learned.sum())
    words = _sum([words[0], np.array([END])], [words[1], np.array([ends])])
    return grams, words


_ASK = "block int, bucket int, kind string, keys binary, counts binary"
_REPLY = "block int, kind string, keys binary, counts binary"


def _gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return C.bucket_of(C.mix(grams >> np.uint64(8) & np.uint64(0xFFFF)), buckets)


def _ask(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        learned = table.column("learned").to_numpy().astype(bool)
        grams, words = _inventory(table.column("text"), learned, depth)
        rows = []
        for kind, (keys, counts), to in (("gram", grams, _gram_bucket(grams[0], buckets)), ("word", words, C.bucket_of(words[0], buckets))):
            order = np.argsort(to, kind="stable")
            cut = C.runs(to[order])
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                k = order[x:y]
                # sorted keys as differences compress well
                rows.append((block, int(to[k[0]]), kind, _thin(keys[k]), counts[k].astype(np.uint32 if not len(k) or counts[k].max() < 1 << 32 else np.uint64).tobytes()))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "bucket", "kind", "keys", "counts"])

    return run


def _thin(keys: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences."""
    import zstandard

    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d).tobytes())


def _thick(packed: bytes) -> np.ndarray:
    import zstandard

    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view("<u8").reshape(-1), dtype=np.uint64)


def _logs(values: np.ndarray) -> bytes:
    """Logarithms in single precision, compressed by byte planes."""
    import zstandard

    v = values.astype("<f4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.T).tobytes())


def _unlogs(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<f4").reshape(-1)


def _counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint32 if len(packed) == 4 * n else np.uint64).astype(np.int64)


def _merged(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [_thick(r["keys"]) for r in rows]
    counts = [_counts(r["counts"], len(k)) for r, k in zip(rows, keys, strict=True)]
    k, c = _sum(keys, counts)
    return keys, k, c


def _gather(depth: int):
    """Of one bucket: the packed totals, and what the nodes of one context byte collect from it."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for kind in ("gram", "word"):
            some = [r for r in rows if r["kind"] == kind]
            if not some:
                continue
            keys, k, c = _merged(some)
            seen = c > 0
            out.append((rows[0]["bucket"], kind, None, _thin(k), c.tobytes(), None, int(seen.sum()), int(c.sum())))
            out += [(rows[0]["bucket"], "ask_" + kind, r["block"], r["keys"], None, None, 0, 0) for r in some]
            if kind == "gram" and seen.any():
                two = grow(k[seen], c[seen], 2, depth)[2]
                up = parent(two.keys, 2)
                order = np.argsort(up, kind="stable")
                at = C.runs(up[order])[:-1]
                total = np.add.reduceat(two.weighted[order], at), np.add.reduceat(two.zeros[order], at), np.add.reduceat(two.ones[order], at)
                out.append((rows[0]["bucket"], "top", None, up[order][at].tobytes(), np.stack(total[1:]).astype(np.int64).tobytes(), total[0].tobytes(), 0, 0))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["bucket", "kind", "block", "keys", "counts", "logs", "distinct", "total"])

    return run


_HELD = "bucket int, kind string, block int, keys binary, counts binary, logs binary, distinct long, total long"


def _add_tops(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for the top of the tree: at most 65,280 rows from a task."""
    keys, logs, zeros, ones = [], [], [], []

    def total() -> None:
        if not keys:
            return
        k = np.concatenate(keys)
        u, inverse = np.unique(k, return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate(logs), minlength=len(u))]
        for part in (zeros, ones):
            s = np.zeros(len(u), np.int64)
            np.add.at(s, inverse, np.concatenate(part))
            sums.append(s)
        keys[:], logs[:], zeros[:], ones[:] = [u], [sums[0]], [sums[1]], [sums[2]]

    for b in rows:
        for r in b.to_pylist():
            k = np.frombuffer(r["keys"], np.uint64)
            c = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
            keys.append(k)
            logs.append(np.frombuffer(r["logs"], np.float64))
            zeros.append(c[0])
            ones.append(c[1])
            if len(keys) > 16:
                total()
    total()
    empty = np.zeros(0)
    yield pa.RecordBatch.from_arrays([pa.array((keys[0] if keys else empty).astype(np.int64)), pa.array(logs[0] if logs else empty), pa.array((zeros[0] if zeros else empty).astype(np.int64)), pa.array((ones[0] if ones else empty).astype(np.int64))], names=["node", "below", "zeros", "ones"])


class Top:
    """Levels 0 and 1 from what their nodes collected: at most 255 + 65,280 nodes."""

    def __init__(self, node: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        order = np.argsort(node)
        one = self._level(node[order].astype(np.uint64), zeros[order], ones[order])
        one.weigh(below[order])
        up = parent(one.keys, 1)
        keys, inverse = np.unique(up, return_inverse=True)
        sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
        np.add.at(sums[0], inverse, one.zeros)
        np.add.at(sums[1], inverse, one.ones)
        zero = self._level(keys, *sums)
        zero.weigh(np.bincount(inverse, one.weighted, minlength=len(keys)))
        self.levels = {0: zero, 1: one}

    @staticmethod
    def _level(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Level:
        level = Level.__new__(Level)
        level.keys, level.zeros, level.ones = keys, zeros, ones
        level.estimate = block_probability(zeros, ones)
        return level


def _answer(top: Top, depth: int):
    """Each block's strings with their logarithms, each block's words with their counts."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for kind in ("gram", "word"):
            held = next((r for r in rows if r["kind"] == kind), None)
            if held is None:
                continue
            k, c = _thick(held["keys"]), np.frombuffer(held["counts"], np.int64)
            if kind == "gram":
                seen = c > 0
                value = predict(k, top.levels | grow(k[seen], c[seen], 2, depth)) if seen.any() else np.full(len(k), -8 * np.log10(2))
            else:
                value = c
            for r in rows:
                if r["kind"] == "ask_" + kind:
                    keys = _thick(r["keys"])
                    v = value[np.searchsorted(k, keys)]
                    out.append((r["block"], kind, r["keys"], _logs(v) if kind == "gram" else (v.astype(np.uint32) if v.max() < 1 << 32 else v.astype(np.uint64)).tobytes()))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["block", "kind", "keys", "counts"])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


class Lookup:
    """Place of keys among sorted distinct ones: hash tables tried in turn, each for what the one before lost."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        for mul in _MULTIPLIERS:
            if len(left) < 64:
                break
            bits = max(8, int(len(left)).bit_length() + 1)
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            slot = keys[left] * mul >> shift
            table[slot] = left
            self.tables.append((mul, shift, table))
            left = left[table[slot] != left]

    def find(self, q: np.ndarray) -> np.ndarray:
        """All of ``q`` must be there."""
        out, open_ = None, None
        for mul, shift, table in self.tables:
            at = table[(q if open_ is None else q[open_]) * mul >> shift]
            if open_ is None:
                out = at
                open_ = np.flatnonzero(self.keys[at] != q)
            else:
                out[open_] = at
                open_ = open_[self.keys[at] != q[open_]]
            if not len(open_):
                return out
        if out is None:
            return np.searchsorted(self.keys, q)
        out[open_] = np.searchsorted(self.keys, q[open_])
        return out


def _apply(depth: int, tokens: int, kinds: int):
    base = np.log10(float(tokens + kinds + 1))

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=[f.split()[0] for f in _SCORED.split(", ")])
        rows, model = replies.to_pylist(), {}
        for kind in ("gram", "word"):
            some = [r for r in rows if r["kind"] == kind]
            keys = [_thick(r["keys"]) for r in some]
            values = [_unlogs(r["counts"]) if kind == "gram" else _counts(r["counts"], len(k)) for r, k in zip(some, keys, strict=True)]
            k, v = (np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, np.uint64), np.zeros(0))
            order = np.argsort(k)
            model[kind] = Lookup(k[order]), v[order]
        n = texts.num_rows
        score, plain, known, words, size = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        k, v = model["word"]
        end = int(v[k.find(np.array([END]))[0]])
        for a, b, data, offs in _chunks(texts.column("text")):
            g, logs = model["gram"]
            ended, ends = _ended(data, offs)
            run_ = np.concatenate([[0.0], np.cumsum(logs[g.find(_strings(ended, ends, depth))].astype(np.float64))])
            score[a:b] = run_[ends[1:]] - run_[ends[:-1]]
            s, e, first = C.word_spans(data, offs)
            c = v[k.find(C.word_hashes(data, s, e))] if len(s) else np.zeros(0, np.int64)
            run_ = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0) - base)])
            plain[a:b] = run_[first[1:]] - run_[first[:-1]] + np.log10(end + 1.0) - base
            run_ = np.concatenate([[0], np.cumsum(c > 0)])
            known[a:b] = run_[first[1:]] - run_[first[:-1]] + (end > 0)
            words[a:b], size[a:b] = np.diff(first) + 1, np.diff(offs)
        return pa.Table.from_arrays([texts.column("doc_id"), texts.column("held_out"), pa.array(words), pa.array(known), pa.array(np.full(n, tokens, np.int64)), pa.array(plain), pa.array(score), pa.array(size)], names=[f.split()[0] for f in _SCORED.split(", ")])

    return run


def score(docs: DataFrame, folds: int = 7, fold: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` (log10), ``bits_per_byte``."""
    spark = C.ship(docs.sparkSession)
    n = C.partitions(spark)
    crc = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc == fold, F.lit(False)).alias("held_out"), F.coalesce(crc != fold, F.lit(False)).alias("learned"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.pmod(F.xxhash64(id_col, F.xxhash64(text_col)), F.lit(n)).cast("int").alias("block"),
    )
    asked = C.grouped(own.select("block", "learned", "text"), "block", _ask(depth, BUCKETS_PER_PARTITION * n), _ASK)
    held = C.materialise(C.grouped(asked, "bucket", _gather(depth), _HELD), "held")
    tops = held.filter("kind = 'top'").select("keys", "counts", "logs").mapInArrow(_add_tops, "node long, below double, zeros long, ones long")
    tops = tops.groupBy("node").agg(F.sum("below").alias("below"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    top = Top(tops["node"].to_numpy(np.int64), tops["below"].to_numpy(float), tops["zeros"].to_numpy(np.int64), tops["ones"].to_numpy(np.int64))
    total = held.filter("kind = 'word'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).collect()[0]
    del asked
    C.release(spark, flush=True)
    replies = C.grouped(held.filter("kind not in ('top')").select("bucket", "kind", "block", "keys", "counts"), "bucket", _answer(top, depth), _REPLY)
    texts = own.select("doc_id", "held_out", "text", "block")
    scored = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_apply(depth, int(total[0]), int(total[1])), _SCORED)
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes")))
