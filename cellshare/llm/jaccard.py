"""N-gram Jaccard join by vertical partitioning, exact, without all pairs of a group.

1. Each block of texts hashes its distinct word n-grams and deals them to buckets, packed.  A bucket sorts its
   n-grams and sends back, packed for each block, those that two or more documents hold, with their frequency.
   A text that can link has at least the threshold's share of such n-grams; the others are done.
2. Documents with the same n-gram set form a class at once; only the class's smallest id goes on.
3. The global order of the n-grams (rarest frequency class first, then hash) is cut into fragments of equal weight.
   Candidates share an n-gram of both prefixes.  For them, partial overlaps are counted in each fragment and
   summed by pair.
4. N-grams of the same rows make one posting list.  Candidates come in rounds: each list's smallest member with the
   others, then, of what hasn't joined it, again the smallest, while a round halves what is left; in the end every
   pair of a list whose components still differ.  Pairs inside a component can't change the result and are never made.

N-grams are known by 64-bit hashes: two that collide count as one.

Nulls, empty texts and texts without words have an empty set, link with nothing and are their own component.
A text with fewer than n words has one n-gram: its whole sequence.  A null id takes no part.  If an id
occurs in several rows, the rows count as documents of their own but share the id's component: links are between
rows, known by a number, and components between ids.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Parts of the global order, with equally many n-grams each.
FRAGMENTS = 4
#: Names of a posting list: a 128-bit hash of its rows.
LIST = ["l0", "l1"]
#: 64-bit words of a text's bitmap, in which each repeated n-gram sets one bit.
BITMAP = 8
BUCKETS_PER_PARTITION = 3
#: A row's number is its block's and, in so many bits, its place in it.
ROW_BITS = 20


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the text of each, repeats included."""
    at, doc = C.window_starts(first, n)
    rolled = C.rolling(words, n)
    grams = rolled[at] if len(at) else np.zeros(0, C.U64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.empty(len(short), C.U64)
    for i, d in enumerate(short):
        w = words[first[d] : first[d + 1]]
        whole[i] = C.rolling(w, len(w))[0] ^ C.U64(0x5851F42D4C957F2D * len(w) & (1 << 64) - 1)
    return np.concatenate([grams, whole]), np.concatenate([doc, short]).astype(np.int64)


def distinct_by_text(grams: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams text by text, and how many each has."""
    order = np.argsort(doc, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))])
    grams = grams[order]
    parts = [np.unique(grams[cut[i] : cut[i + 1]]) for i in range(texts)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else grams), sizes


def _small(sizes: np.ndarray) -> bytes:
    """Numbers in the smallest of three types, its width first."""
    top = int(sizes.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + sizes.astype(f"<u{width}").tobytes()


def _sizes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


_SENT = "block long, bucket int, ids binary, sizes binary, grams binary"


def _deal(n: int, buckets: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 43 - ROW_BITS
        for b in C.blocks(batches, text_col):
            block += 1
            ids = np.asarray(b.column(b.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False), np.int64)
            data, offs = C.utf8(b.column(b.schema.get_field_index(text_col)))
            data = C.lower_ascii(data)
            s, e, first = C.word_spans(data, offs)
            grams, doc = shingles(C.word_hashes(data, s, e), first, n)
            grams, sizes = distinct_by_text(grams, doc, len(ids))
            to = C.bucket_of(grams, buckets)
            order = np.argsort(to.astype(np.uint16 if buckets < 1 << 16 else np.int32), kind="stable")
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
            grams, cut = grams[order], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])
            out = [(block, block % buckets, ids.tobytes(), sizes.astype(np.int32).tobytes(), None)]
            for k in range(buckets):
                if cut[k] < cut[k + 1]:
                    held = np.bincount(doc[cut[k] : cut[k + 1]], minlength=len(ids))
                    out.append((block, k, None, _small(held), grams[cut[k] : cut[k + 1]].tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["block", "bucket", "ids", "sizes", "grams"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: each block's n-grams that two or more documents hold, with their frequency classes (quarter octaves)."""
    rows = table.to_pylist()
    out = [(r["block"], r["ids"], r["sizes"], None, None) for r in rows if r["grams"] is None]
    rows = [r for r in rows if r["grams"] is not None]
    if rows:
        grams = [np.frombuffer(r["grams"], C.U64) for r in rows]
        cut = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        every = np.concatenate(grams)
        order = np.argsort(every)
        at = C.runs(every[order])
        count = np.empty(len(every), np.uint8)
        n = np.diff(at)
        count[order] = np.repeat(np.floor(4 * np.log2(n)).astype(np.uint8), n)
        for i, r in enumerate(rows):
            c, g = count[cut[i] : cut[i + 1]], grams[i]
            keep = c > 0
            if keep.any():
                held = _sizes(r["sizes"])
                doc = np.repeat(np.arange(len(held)), held)[keep]
                out.append((r["block"], None, _small(np.bincount(doc, minlength=len(held))), g[keep].tobytes(), c[keep].tobytes()))
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "ids", "sizes", "grams", "freqs"])


def _assemble(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: for each text the size of its set and, if it can link, its repeated n-grams in global order."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, n = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["sizes"], np.int32)
        rows = [r for r in rows if r["grams"] is not None]
        docs = [np.repeat(np.arange(len(ids)), _sizes(r["sizes"])) for r in rows]
        empty = np.zeros(0, np.int64)
        doc = np.concatenate(docs) if docs else empty
        grams = np.concatenate([np.frombuffer(r["grams"], C.U64) for r in rows]) if rows else empty.astype(C.U64)
        freq = np.concatenate([np.frombuffer(r["freqs"], np.uint8) for r in rows]) if rows else empty.astype(np.uint8)
        held = np.bincount(doc, minlength=len(ids))
        able = (held * 100 >= n.astype(np.int64) * percent) & (n > 0)
        keep = able[doc] if len(doc) else np.zeros(0, bool)
        doc, grams, freq = doc[keep], grams[keep], freq[keep]
        # the global order: frequency class, then hash
        order = np.lexsort((grams, freq, doc))
        doc, freq, key = doc[order], freq[order], grams[order].view(np.int64)
        cut = np.concatenate([[0], np.cumsum(np.where(able, held, 0))])
        packed = [key[cut[i] : cut[i + 1]] if able[i] else None for i in range(len(ids))]
        full = [xxhash.xxh3_128_hexdigest(p.tobytes()) if p is not None and held[i] == n[i] else None for i, p in enumerate(packed)]
        bits = np.zeros((len(ids), BITMAP * 64), np.uint8)
        bits[doc, key & (BITMAP * 64 - 1)] = 1
        maps = np.packbits(bits, axis=1).view(np.int64)
        at = C.runs(doc.astype(np.int64) << 8 | freq)
        head_of = np.searchsorted(doc[at[:-1]], np.arange(len(ids) + 1))
        classes, each = freq[at[:-1]].astype(np.int32), np.diff(at).astype(np.int32)
        of = lambda values: pa.array([values[head_of[i] : head_of[i + 1]] if able[i] else None for i in range(len(ids))], pa.list_(pa.int32()))
        row = (head["block"] << ROW_BITS) + np.arange(len(ids), dtype=np.int64)
        return pa.Table.from_arrays([pa.array(row), pa.array(ids), pa.array(n.astype(np.int64)), pa.array(full, pa.string()), pa.array(packed, pa.list_(pa.int64())), of(classes), of(each), pa.array(list(maps), pa.list_(pa.int64()))], names=["row", "doc_id", "n_shingles", "class_key", "keys", "classes", "each", "bitmap"])

    return run


def sets(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_shingles, class_key, keys, classes, each, bitmap``: keys only for texts that can link, in the global
    order; ``classes`` are their frequency classes, each with as many keys as ``each`` says."""
    spark = C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    sent = own.mapInArrow(C.lean(_deal(n, BUCKETS_PER_PARTITION * C.partitions(spark), "doc_id", "text")), _SENT)
    back = C.grouped(sent, "bucket", _repeated, "block long, ids binary, sizes binary, grams binary, freqs binary")
    return C.materialise(C.grouped(back, "block", _assemble(percent), "row long, doc_id long, n_shingles long, class_key string, keys array<long>, classes array<int>, each array<int>, bitmap array<long>"), "sets")


def bounds(reps: DataFrame, fragments: int) -> list[tuple[int, int]]:
    """Where the global order is cut, as (frequency class, hash): into parts that hold equally many n-grams of all sets.

    Hashes are spread evenly, so that within a class a share of the n-grams is a share of the hashes.
    """
    both = F.arrays_zip(F.col("classes").alias("c"), F.col("each").alias("n"))
    # as many rows as there are classes: 256 at most
    held = sorted((r.c, r.n) for r in reps.select(F.explode(both).alias("x")).groupBy(F.col("x.c").alias("c")).agg(F.sum("x.n").alias("n")).collect())
    total, out, before = sum(n for _, n in held), [], 0
    for c, n in held:
        while len(out) < fragments - 1 and (at := total * (len(out) + 1) // fragments) < before + n:
            out.append((c, ((at - before) << 64) // n))
        before += n
    return out


def _segments(cuts: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, fragment, parts = [], [], []
            for r, keys, classes, each in zip(*(c.to_pylist() if k != 1 else c for k, c in enumerate(batch.columns)), strict=True):
                signed = np.asarray(keys.values, np.int64)
                grams, at = signed.view(C.U64), np.concatenate([[0], np.cumsum(each)])
                edge = [0]
                for c, h in cuts:
                    i = bisect_left(classes, c)
                    start = int(at[i])
                    edge.append(start + int(np.searchsorted(grams[start : at[i + 1]], C.U64(h))) if i < len(classes) and classes[i] == c else start)
                for k, (x, y) in enumerate(zip(edge, [*edge[1:], len(grams)], strict=True)):
                    if x < y:
                        row.append(r)
                        fragment.append(k)
                        parts.append(signed[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(fragment, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["row", "fragment", "keys"])

    return run


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``a, b, common``: of rows, partial overlaps counted fragment by fragment and summed by pair."""
    left = pairs.join(segments.select(F.col("row").alias("a"), "fragment", F.col("keys").alias("ka")), "a")
    both = left.join(segments.select(F.col("row").alias("b"), "fragment", F.col("keys").alias("kb")), ["b", "fragment"])
    part = both.select("a", "b", F.size(F.array_intersect("ka", "kb")).cast("long").alias("part"))
    return part.groupBy("a", "b").agg(F.sum("part").alias("common"))


def posting_lists(reps: DataFrame, percent: int) -> DataFrame:
    """``l0, l1, row, place, doc_id, size``: who shares a prefix n-gram, each set of rows once.

    Neighbouring n-grams of a passage stand in the same rows.  Lists alike are known by a 128-bit hash of their
    rows and become one, with each row's first place in the order: what a pair can still have in common is largest there.
    """
    need = F.ceil(F.col("n_shingles") * percent / 100)
    # n-grams of frequency one come first in the order and can't match, so they only shorten the rest
    prefix = F.slice("keys", 1, (F.size("keys") - need + 1).cast("int"))
    posts = reps.filter(F.col("able") >= need).select("row", F.posexplode(prefix).alias("place", "key"))
    alike = posts.groupBy("key").agg(F.bit_xor(F.xxhash64("row")).alias("l0"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("l1"), F.count("*").alias("m")).filter("m > 1").drop("m")
    # a table of its own, so that the join may split an n-gram of very many rows
    merged = posts.join(C.materialise(alike, "alike"), "key").groupBy(*LIST, "row").agg(F.min("place").alias("place"))
    return C.materialise(merged.join(reps.select("row", "doc_id", F.struct("n_shingles", "able", "bitmap").alias("size")), "row"), "postings")


def possible(x: str, y: str, percent: int) -> Column:
    """Whether two postings of a list can be of rows that link, were this the first n-gram that they share.

    Needed are p/(1+p) of both sizes together.  What sets a bit in one bitmap alone isn't common to both, and only
    what stands from this place on can be.
    """
    alone = sum((F.bit_count(F.col(f"{x}.size.bitmap")[i].bitwiseXOR(F.col(f"{y}.size.bitmap")[i])) for i in range(BITMAP)), F.lit(0))
    rest = F.least(F.col(f"{x}.size.able") - F.col(f"{x}.place"), F.col(f"{y}.size.able") - F.col(f"{y}.place"))
    needed = (F.col(f"{x}.size.n_shingles") + F.col(f"{y}.size.n_shingles")) * percent
    return (rest * (100 + percent) >= needed) & ((F.col(f"{x}.size.able") + F.col(f"{y}.size.able") - alone) * (100 + percent) >= needed * 2)


def join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and links: ``(doc_id, n_shingles, component_id)`` and the verified links ``(a, b, common)``.

    Links are between class representatives; those not needed to connect a component are left out.
    """
    every = sets(docs, n, percent, id_col, text_col)
    C.release(docs.sparkSession, flush=True)
    able = every.filter("keys is not null")
    # a class: the same set; a row of its smallest id goes on.  A text with an n-gram of its own is alone in its class.
    classes = able.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "row")).alias("r"))
    classes = classes.select("class_key", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("row"))
    members = able.filter("class_key is not null").select("doc_id", "class_key").join(classes.drop("row"), "class_key").select("doc_id", "rep")
    # an id of several rows joins the classes that these are in
    several = able.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    bridges = members.filter("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    bridges = C.materialise(bridges, "bridges")
    reps = able.filter("class_key is null").unionByName(able.join(classes.select("row"), "row", "left_semi").select(able.columns))
    reps = C.materialise(reps.select("row", "doc_id", "n_shingles", F.size("keys").alias("able"), "bitmap", "keys", "classes", "each"), "reps")
    cut = _segments(bounds(reps, FRAGMENTS))
    segments = C.materialise(reps.select("row", "keys", "classes", "each").mapInArrow(C.lean(cut), "row long, fragment int, keys array<long>"), "segments")
    postings = posting_lists(reps, percent)

    def verified(met: DataFrame, name: str) -> DataFrame:
        """Of rows ``x`` and ``y`` that met in some list, those that link."""
        turn = F.col("x.row") < F.col("y.row")
        pick = lambda c, low: F.when(turn, F.col(f"{'x' if low else 'y'}.{c}")).otherwise(F.col(f"{'y' if low else 'x'}.{c}"))
        near = met.select(pick("row", True).alias("a"), pick("row", False).alias("b"), pick("doc_id", True).alias("ia"), pick("doc_id", False).alias("ib"), pick("size.n_shingles", True).alias("na"), pick("size.n_shingles", False).alias("nb")).distinct()
        got = overlaps(near, segments).join(near, ["a", "b"])
        return C.materialise(got.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common"), name)

    def labelled(some: DataFrame, label: DataFrame) -> DataFrame:
        own = some.drop("component").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return own.withColumn("component", F.coalesce("component", "doc_id"))

    def centred(some: DataFrame, name: str) -> DataFrame:
        """``l0, l1, c``: the smallest member of each list that has several components."""
        low = some.groupBy(*LIST).agg(F.min(F.struct("doc_id", "row", "place", "size", "component")).alias("c"), F.min("component").alias("p"), F.max("component").alias("q"))
        return C.materialise(low.filter("p <> q").drop("p", "q"), name)

    def apart(now: DataFrame) -> int:
        """Pairs of a list whose components differ, over all lists."""
        shares = now.groupBy(*LIST, "component").agg(F.count("*").alias("m"))
        lists = shares.groupBy(*LIST).agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
        return lists.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).collect()[0][0]

    # rounds: the smallest member of each list with the others, then, of what hasn't joined it, again the smallest
    total, before, k = postings.count(), float("inf"), 0
    rest, links, label = postings.withColumn("component", F.col("doc_id")), None, None
    centres = centred(rest, "centres0")
    while True:
        k += 1
        met = rest.alias("x").join(centres, LIST).filter("component <> c.component").select(F.struct("x.row", "x.doc_id", "x.place", "x.size").alias("x"), F.col("c").alias("y"))
        found = verified(met.filter(possible("x", "y", percent)), f"links{k}")
        links = found if links is None else links.unionByName(found)
        label = C.components(links.select("a", "b").unionByName(bridges))
        now = C.materialise(labelled(postings, label), f"now{k}")
        left = apart(now)
        if left <= total or left > before / 2:
            break
        before = left
        rest = labelled(rest, label)
        joined = centred(rest, f"joined{k}").select(*LIST, F.col("c.component").alias("main"))
        rest = C.materialise(rest.join(joined, LIST).filter("component <> main").drop("main"), f"rest{k}")
        centres = centred(rest, f"centres{k}")
    # every pair of a list whose components still differ: one side isn't in the component that the list has most of
    shares = now.groupBy(*LIST, "component").agg(F.count("*").alias("m"))
    most = shares.groupBy(*LIST).agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    open_lists = C.materialise(now.join(C.materialise(most.select(*LIST, F.col("most.component").alias("main")), "most"), LIST), "open")
    x, y = open_lists.filter("component <> main").alias("x"), open_lists.alias("y")
    # two rows that are both outside it meet once
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.row") < F.col("y.row"))
    far = x.join(y, (F.col("x.l0") == F.col("y.l0")) & (F.col("x.l1") == F.col("y.l1")) & (F.col("x.component") != F.col("y.component")) & once & possible("x", "y", percent))
    links = links.unionByName(verified(far, "links"))
    label = C.components(links.select("a", "b").unionByName(bridges))
    # members of a class follow their representative
    own = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    named = own.unionByName(label.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))).groupBy("doc_id").agg(F.min("c").alias("c"))
    out = every.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out, links


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest id.  Rows with a null id stay."""
    out, _ = join(docs)
    gone = out.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
