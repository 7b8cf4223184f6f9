"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a variant at most half the radius from both, so every distinct
fingerprint emits all variants in that ball (2081 of 64 bits for a radius of 4) and equal variants meet.  Variants
don't travel one by one: those that share their first bits go to that region as one record, the fingerprint itself,
and are made there.  A fingerprint reaches the regions within half the radius of its own first bits, with the flips
that are left to spend on the rest.  The number of first bits follows the number of fingerprints; a region that would
hold more than ``MOST`` variants is split by further bits, as often as needed, so a task's memory is bounded however
alike the fingerprints are.

In a region, variants are sorted and equal ones give links to the smallest fingerprint that has them, deduplicated
and verified by counting bits; links inside a region are reduced to one for each fingerprint and component.  All
that share a variant are within the radius of each other, so no pair is needed beyond these.

A bit of a fingerprint is 1 if more than half of the document's shingle hashes (XXH64, seed 42) have it.  Texts
without words (null and empty ones too) have fingerprint zero and are linked like any other.  Rows that share an id, or
have none, are documents of their own; a component of rows without ids alone has a null id.  Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Variants that one region makes at most, and the bits by which a larger one is split.
MOST = 4 << 20
STEP = 6
_CHUNK = 1 << 15


# ---------------------------------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``width`` words of a text, repeats included; of all words if there are fewer."""
    text = b" ".join(text.lower().split())  # bytes: ASCII letters and white space alone
    if not text:
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(text)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < width:
        return np.array([digest(text, SEED)], np.uint64)
    return np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])), np.uint64, len(starts) - width + 1)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        raw = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.blocks(batches):
        data, offs = C.utf8(b.column(1))
        raw = data.tobytes()
        own = np.array([fingerprint(shingle_hashes(raw[x:y])) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint as a signed number of 64 bits."""
    C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(C.lean(_prints), "doc_id long, fp long")


# ------------------------------------------------------------------------------------------------ balls
def ball(width: int, radius: int) -> int:
    """Number of variants of ``width`` bits with at most ``radius`` flips."""
    return sum(comb(width, k) for k in range(min(width, radius) + 1))


def flips(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(min(width, radius) + 1) for c in combinations(range(width), k)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _first(fp: Column, bits: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - bits) if bits else F.lit(0).cast("long")


def _spent(bits: int) -> Column:
    """Flips that took the fingerprint to its region."""
    return F.bit_count(_first(F.col("fp"), bits).bitwiseXOR(F.col("region")))


def _weight(bits: int, half: int) -> Column:
    """Variants that a fingerprint makes in its region."""
    out = F.lit(ball(BITS - bits, 0))
    for d in range(half):
        out = F.when(_spent(bits) == d, ball(BITS - bits, half - d)).otherwise(out)
    return out.cast("long")


def regions(prints: DataFrame, half: int, most: int = MOST) -> list[tuple[int, DataFrame]]:
    """``(bits, (region, fp))``: where every distinct fingerprint's variants lie, no region with more than ``most`` of them.

    Regions of the same depth come as one table in the shared folder.
    """
    n = prints.count()
    bits = min(BITS, max(0, ceil(log2(max(1, n * ball(BITS, half) / most)))))
    masks = F.array(*[F.lit(_signed(m)) for m in flips(bits, half)])
    dealt, out = prints.select(_first(F.col("fp"), bits).alias("first"), "fp").select(F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("first")))).alias("region"), "fp"), []
    while True:
        load = dealt.groupBy("region").agg(F.sum(_weight(bits, half)).alias("load"), F.count("*").alias("n"))
        # one fingerprint's variants in a region can't be parted for ever: below the last bits there is one
        hot = C.materialise(load.filter((F.col("load") > most) & F.lit(bits < BITS)).select("region"), "hot")
        if hot.isEmpty():
            return [*out, (bits, dealt)]
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(32)))
        every = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")))).withColumn("is_hot", F.lit(True))
        marked = C.materialise(salted.join(every, ["region", "salt"], "left").select("region", "fp", "is_hot"), "regions")
        out.append((bits, marked.filter("is_hot is null").select("region", "fp")))
        deeper = min(BITS, bits + STEP)
        masks = F.array(*[F.lit(_signed(m)) for m in flips(deeper - bits, half)])
        step = deeper - bits
        again = marked.filter("is_hot").select("region", "fp", _spent(bits).alias("spent"), _first(F.col("fp"), deeper).bitwiseAND(F.lit((1 << step) - 1)).alias("next"))
        again = again.select("region", "fp", "spent", "next", F.explode(masks).alias("mask")).filter(F.col("spent") + F.bit_count("mask") <= half)
        dealt = again.select(F.shiftleft("region", step).bitwiseOR(F.col("next").bitwiseXOR(F.col("mask"))).alias("region"), "fp")
        bits = deeper


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for few nodes in memory."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _met(bits: int, half: int):
    """Links of one region: fingerprints that share a variant, as pairs with the smallest of their component."""
    low, radius = BITS - bits, 2 * half
    mask = np.uint64((1 << low) - 1 if low < 64 else 2**64 - 1)
    ways = {d: np.array(flips(low, half - d), np.uint64) for d in range(half + 1)}

    def run(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))
        region = np.uint64(int(t.column("region")[0].as_py()) & (2**64 - 1))
        first = fp >> np.uint64(low) if bits else np.zeros(len(fp), np.uint64)
        spent = np.bitwise_count(first ^ region)
        groups = [np.flatnonzero(spent == d) for d in range(half + 1)]
        variants = np.concatenate([((fp[g] & mask)[:, None] ^ ways[d][None, :]).ravel() for d, g in enumerate(groups)])
        ordered = np.sort(variants)
        shared = ordered[1:][ordered[1:] == ordered[:-1]]
        shared = shared[C.runs(shared)[:-1]] if len(shared) else shared
        if not len(shared):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        del ordered
        owner = np.concatenate([np.repeat(g, len(ways[d])) for d, g in enumerate(groups)])
        at = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == variants)
        at, owner = at[hit], owner[hit]
        least = np.full(len(shared), len(fp))
        np.minimum.at(least, at, owner)
        pair = np.unique(least[at] * np.int64(len(fp)) + owner)
        a, b = pair // len(fp), pair % len(fp)
        near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
        root = _roots(len(fp), a[near], b[near])
        other = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[root[other]].view(np.int64)), "b": pa.array(fp[other].view(np.int64))})

    return run


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints in one component of those at most ``radius`` bits apart, enough to span it."""
    if radius % 2 or not 0 <= radius <= BITS:
        raise ValueError("the radius must be even: the balls of two fingerprints are to meet in the middle")
    half, every = radius // 2, None
    for bits, dealt in regions(prints, half, most):
        found = dealt.groupBy("region").applyInArrow(_met(bits, half), "a long, b long")
        every = found if every is None else every.unionByName(found)
    return every.distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` of every row."""
    own = C.materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    one = C.materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = C.materialise(links(one.select("fp"), radius, most), "links")
    label = C.components(found).withColumnRenamed("node", "fp")
    # fingerprints without a link are their own component and need no join
    linked = C.materialise(label.join(one, "fp").select("fp", "component", "least"), "linked")
    top = linked.groupBy("component").agg(F.min("least").alias("id"))
    joined = C.spread_join(linked, top, "component").select("fp", "id")
    by_print = C.materialise(one.join(joined.withColumn("is_linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("id")).otherwise(F.col("least")).alias("component_id")), "components")
    return C.spread_join(own, by_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
