"""Line dedup: a suffix array over line ids by distributed prefix doubling, with DataFrame functions only.

Lines are alike if two 64-bit hashes are; those that occur twice get numbers for ids.  A suffix starts at each line and runs to the end of its text.  Round k
ranks suffixes by their first 2**k lines: two neighbouring ranks of round k - 1 make a pair, the distinct pairs are
sorted over all partitions, and a pair's place is the new rank.  A suffix whose rank nobody shares is done, so
rounds work on repeated stretches alone and end when the longest is passed.

Suffixes of equal rank are an interval of the suffix array whose common prefix has at least 2**k lines.  The first
suffix of an interval, by id and line, is the original; the others start later copies.  How long a later copy is, its
longest common prefix with a suffix before it, is searched between the last round that has it as a copy and the next:
n lines, 2**k <= n <= 2**(k+1), are alike if the first and the last 2**k of them are, so the ranks of round k at two
places tell, and all suffixes of an interval are searched side by side, one bit of the length at a time.  Of an
interval only the first suffix of each interval of the next round takes part: it stands for the others.

A later copy that isn't the tail of one that starts a line before is a maximal repeated run: it can't be extended to
either side.  Its lines are deleted if together they have ``min_chars`` characters; with ``MIN_CHARS``, which is 1,
no later copy of a line that isn't blank stays.  A copy may overlap its own original, as in ``a a a``: the
second and third line are a later copy of the first and second, and the first alone stays.

Blank lines (empty or spaces) are never deleted and end a run.  Null texts stay null; empty texts stay.  Rows
alike in id and text count as one document and keep the same lines; rows that share an id alone are ordered by
their text's hash.  Rows with a null id come first, as one document for each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS = 1
NO_ID = -(1 << 63)
DOC = ["d", "t"]
#: Names that a table's own columns don't have.
OWN = "__line_runs_"


def key_columns(id_col: str, text_col: str) -> dict[str, Column]:
    """The id and the hash of the text: the order of documents and the key of a row."""
    return {"d": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "t": F.xxhash64(text_col)}


def place() -> Column:
    """What a suffix is known and ordered by."""
    return F.struct(*DOC, "seq")


def repeated_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``d, t, seq, rank, size``: lines that occur more than once, with their ids as first ranks and their lengths."""
    lines = docs.select(*DOC, F.posexplode(F.split(text_col, "\n")).alias("seq", "line")).filter(F.trim("line") != "")
    both = {"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")}
    lines = C.materialise(lines.select(*DOC, "seq", *[v.alias(k) for k, v in both.items()], F.length("line").alias("size")), "lines")
    # a table of its own: the join may then split a line that has very many copies
    shared = C.materialise(lines.groupBy(*both).agg(F.count("*").alias("n")).filter("n > 1").select(*both, F.monotonically_increasing_id().alias("rank")), "shared")
    out = C.materialise(lines.join(shared, [*both]).select(*DOC, "seq", "rank", "size").dropDuplicates([*DOC, "seq"]), "repeated")
    C.discard(lines, shared)
    return out


def flagged(level: DataFrame, k: int) -> DataFrame:
    """``d, t, seq, rank, later``: whether a suffix isn't the first of its interval.

    The firsts are a table of their own, so that the join may split a line that has very many copies.
    """
    first = C.materialise(level.groupBy("rank").agg(F.min(place()).alias("first")), f"first{k}")
    out = C.materialise(level.join(first, "rank").select(*DOC, "seq", "rank", (place() > F.col("first")).alias("later")), f"level{k}")
    C.discard(first)
    return out


def doubled(level: DataFrame, step: int, k: int) -> DataFrame:
    """Ranks by twice as many lines, for suffixes that share theirs."""
    after = level.select(*DOC, (F.col("seq") - step).alias("seq"), F.col("rank").alias("next"))
    pairs = C.materialise(level.select(*DOC, "seq", "rank").join(after, [*DOC, "seq"]), f"pairs{k}")
    shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "next")
    n = C.partitions(level.sparkSession)
    # sorted over all partitions, ids given in order are ranks
    ranked = shared.repartitionByRange(n, "rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id())
    ranked = C.materialise(ranked, f"ranks{k}")
    out = C.materialise(pairs.join(ranked, ["rank", "next"]).select(*DOC, "seq", F.col("new").alias("rank")), f"doubled{k}")
    C.discard(pairs, ranked)
    return out


def _longest(levels: list[DataFrame]) -> DataFrame:
    """``d, t, seq, len``: every later copy with the lines that it has in common with the suffix before it that has most."""
    copies = [level.filter("later").select(*DOC, "seq") for level in levels]
    beyond = [*copies[1:], copies[-1].limit(0)]
    found = copies[0].join(beyond[0], [*DOC, "seq"], "left_anti").withColumn("len", F.lit(1))
    if len(levels) == 1:
        return found
    members = None
    for k, level in enumerate(levels[1:], 1):
        own = level.join(beyond[k], [*DOC, "seq"], "left_anti")
        own = own.join(own.filter("later").select("rank").distinct(), "rank", "left_semi")
        own = own.select(F.lit(k).alias("k"), *DOC, "seq", "rank", "later", F.lit(1 << k).alias("len"))
        members = own if members is None else members.unionByName(own)
    ranks = None
    for k, level in enumerate(levels[1:], 1):
        own = level.select(F.lit(k).alias("k"), *DOC, F.col("seq").alias("at"), F.col("rank").alias("last"))
        ranks = own if ranks is None else ranks.unionByName(own)
    members = C.materialise(members, "members")
    for j in reversed(range(len(levels) - 1)):
        tried = members.filter(F.col("k") > j)
        wanted = tried.filter("later").select("k", "rank", (F.col("len") + (1 << j)).alias("try")).distinct()
        # the last 2**k lines of so many; a suffix that has none there is alone
        at = (F.col("seq") + F.col("try") - F.expr("shiftleft(1, k)")).alias("at")
        met = tried.join(wanted, ["k", "rank"]).select("k", "rank", "try", *DOC, "seq", (F.col("later") & (F.col("try") == F.col("len") + (1 << j))).alias("own"), at)
        met = C.materialise(met.join(ranks, ["k", *DOC, "at"]).drop("at"), f"tried{j}")
        alike = ["k", "rank", "try", "last"]
        first = C.materialise(met.groupBy(*alike).agg(F.min(place()).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), f"firsts{j}")
        longer = met.filter("own").join(first, alike).filter(place() > F.col("first")).select("k", *DOC, "seq", F.lit(1 << j).alias("more"))
        before, members = members, C.materialise(members.join(longer, ["k", *DOC, "seq"], "left").withColumn("len", F.col("len") + F.coalesce("more", F.lit(0))).drop("more"), f"members{j}")
        C.discard(met, first, before)
    return found.unionByName(members.filter("later").select(*DOC, "seq", "len"))


def maximal_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``d, t, first, last, chars``: later copies that can't be extended to either side, the last exclusive."""
    lines = repeated_lines(docs, text_col)
    level, levels = lines.select(*DOC, "seq", "rank"), []
    while not level.isEmpty():
        k = len(levels)
        levels.append(flagged(level, k))
        if k:
            C.discard(level)
        level = doubled(levels[k], 1 << k, k + 1)
    if not levels:
        return lines.select(*DOC, F.col("seq").alias("first"), F.col("seq").alias("last"), F.lit(0).cast("long").alias("chars")).limit(0)
    found = C.materialise(_longest(levels), "longest")
    C.discard(level, *levels)
    order = Window.partitionBy(*DOC).orderBy("seq")
    before = (F.lag("seq").over(order) == F.col("seq") - 1) & (F.lag("len").over(order) > F.col("len"))
    found = found.withColumn("tail", F.coalesce(before, F.lit(False))).filter("not tail")
    # characters up to each repeated line; a run has no other lines
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    every, lines = lines, C.materialise(lines.join(found.select(*DOC).distinct(), DOC, "left_semi").select(*DOC, "seq", "size", so_far.alias("upto")), "upto")
    C.discard(every)
    begin = lines.select(*DOC, "seq", (F.col("upto") - F.col("size")).alias("before"))
    end = lines.select(*DOC, (F.col("seq") + 1).alias("last"), "upto")
    run = found.withColumn("last", F.col("seq") + F.col("len")).join(begin, [*DOC, "seq"]).join(end, [*DOC, "last"])
    return run.select(*DOC, F.col("seq").alias("first"), "last", (F.col("upto") - F.col("before")).alias("chars"))


def runs(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``d, t, first, last``: stretches of lines to delete, the last exclusive: runs that are long enough, joined where they touch."""
    found = C.materialise(maximal_runs(docs, text_col).filter(F.col("chars") >= min_chars), "runs")
    order = Window.partitionBy(*DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def _cut(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """All rows and columns, and under ``OWN`` names the lines and numbers of lines to delete."""
    keys = key_columns(id_col, text_col)
    slim = docs.select(*[v.alias(k) for k, v in keys.items()], F.col(text_col).alias("text"))
    every = runs(slim, "text", min_chars).groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    every = every.select(*[F.col(c).alias(f"{OWN}{c}") for c in every.columns])
    own = docs.withColumns({f"{OWN}{k}k": v for k, v in keys.items()})
    on = [F.col(f"{OWN}{k}k") == F.col(f"{OWN}{k}") for k in DOC]
    both = own.join(every, on, "left").withColumn(f"{OWN}lines", F.split(text_col, "\n"))
    gone = F.flatten(F.transform(f"{OWN}runs", lambda r: F.sequence(r["first"], r["last"] - 1)))
    both = both.withColumn(f"{OWN}gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{OWN}lines") - 1), f"{OWN}gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(f"{OWN}lines", i)), "\n")
    return both.withColumn(f"{OWN}kept", F.when(F.size(f"{OWN}gone") == 0, F.col(text_col)).otherwise(kept))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, kept, n_lines, n_deleted, n_runs`` for every row; ``kept`` is the text without later copies."""
    size = lambda c: F.coalesce(F.when(F.col(f"{OWN}{c}").isNotNull(), F.size(f"{OWN}{c}")), F.lit(0)).cast("long")
    return _cut(docs, id_col, text_col, min_chars).select(
        F.col(id_col).alias("doc_id"), F.col(f"{OWN}kept").alias("kept"), size("lines").alias("n_lines"), size("gone").alias("n_deleted"), size("runs").alias("n_runs")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Later copies of line runs are cut from the texts; a document of which nothing is left goes."""
    kept = F.col(f"{OWN}kept")
    out = _cut(docs, "doc_id", "text", min_chars).filter((F.size(f"{OWN}gone") == 0) | (F.trim(F.regexp_replace(kept, "\n", "")) != ""))
    new = {"text": kept} | ({"n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
