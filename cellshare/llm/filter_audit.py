"""Interaction of quality filters: what each removes alone, after the others and in every order.

A relational word pipeline.  Texts are dealt by document once; words are exploded and counted by document and
word, and these rows by document, for totals and distinct words.  The other failure conditions are joined on:
capitals and marks from the text, earlier copies from the smallest id of each text, quality and toxicity from the
labels.  A document's failures are a number below 32; one aggregation by part counts each of the 32 combinations, and
every order of the filters is read from these counts.

The filters: A too few words, B too few distinct words, C too many capitals, D a mark, E a copy of a smaller id's text.

Null texts are empty, null parts are the empty string.  A row with a null id is a document that fails E never and has
no labels.  Rows alike in id and text fail alike and count as often as they occur.  Of several labels for an id
any 1 counts; null labels count as 0.  An empty table gives no rows.  Copies are told by 256-bit hashes of the
texts; texts under one id are told apart by 64 bits.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"


def word_totals(docs: DataFrame) -> DataFrame:
    """``i, h, n_words, n_distinct`` of ``i, h, text``; rows alike in ``i, h`` are one document.

    After the explosion nothing travels: both aggregations are satisfied by how the texts were dealt.  A null beside
    the words stands for the row itself, so that documents without words stay and repeated rows can be told.
    """
    words = F.concat(F.split("text", SPACE), F.array(F.lit(None).cast("string")))
    each = docs.repartition("i", "h").select("i", "h", F.explode(words).alias("word")).filter("word is null or word <> ''")
    by_word = each.groupBy("i", "h", "word").agg(F.count("*").alias("n"))
    rows, total = F.max(F.when(F.col("word").isNull(), F.col("n"))), F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    by_doc = by_word.groupBy("i", "h").agg(rows.alias("rows"), total.alias("total"), F.count("word").alias("n_distinct"))
    return by_doc.select("i", "h", F.expr("coalesce(total, 0) div rows").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
             least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2, marks: str = r"[#$%&*|]") -> DataFrame:
    """``doc_id, part, n, failed, good, toxic``: how often a row occurs, its failures as bits (A is 1), its labels."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"i": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("text")})
    capitals = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * most_capitals
    flags = own.select("doc_id", "part", "i", "h", F.unhex(F.sha2("text", 256)).alias("same"), capitals.alias("c"), F.col("text").rlike(marks).alias("d"))
    flags = flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))
    # a key of id and text: copies don't gather at their text
    first = flags.groupBy("same").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("is_first", F.lit(True))
    flags = flags.join(first, ["same", "doc_id"], "left").withColumn("e", F.col("is_first").isNull() & F.col("doc_id").isNotNull())
    one = lambda c: F.coalesce(F.max(F.col(c).cast("int") == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    flags = flags.join(known, "doc_id", "left")
    words = word_totals(own.select("i", "h", "text"))
    every = words.join(flags, ["i", "h"], "full")
    few, same = F.col("n_words") < least_words, F.col("n_distinct") * 100 < F.col("n_words") * least_distinct
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate((few, same, F.col("c"), F.col("d"), F.col("e")))), F.lit(0))
    return every.select("doc_id", "part", "n", bits.alias("failed"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counts(failed: DataFrame) -> DataFrame:
    """``part`` and three arrays of 32 counts: all documents, good ones and toxic ones by their failures."""
    of = lambda m, more: F.sum(F.when((F.col("failed") == m) & more, F.col("n")).otherwise(0)).alias
    kinds = {"docs": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = failed.groupBy("part").agg(*[of(m, more)(f"{kind}_{m}") for kind, more in kinds.items() for m in range(MASKS)])
    return wide.select("part", *[F.array(*[f"{kind}_{m}" for m in range(MASKS)]).alias(kind) for kind in kinds])


def _sum(kind: str, keep, weight=lambda m: F.lit(1)) -> Column:
    """The counts of the combinations for which ``keep`` holds, each times its weight."""
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(MASKS - 1)), keep), F.lit(0).cast("long"), lambda acc, m: acc + F.col(kind)[m] * weight(m))


def audit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``settings`` go to ``failures``.  A filter is the first to remove a document that fails k filters in 120 / k orders.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    rows = counts(failures(docs, labels, **settings)).select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", at, F.lit(1))) - ord("A"))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda acc, k: F.when(k < F.col("step"), acc + bit(k)).otherwise(acc))
    rows = rows.withColumns({"own": bit(F.col("step")), "before": before})
    fails, earlier = lambda m: m.bitwiseAND(F.col("own")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~earlier(m)
    orders_of = len(list(permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step",
        _sum("docs", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _sum("docs", here).alias("removed"),
        _sum("docs", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.col("docs")[F.col("own")].alias("unique_fails"),
        _sum("good", here).alias("good_lost"),
        _sum("toxic", here).alias("toxic_lost"),
        _sum("docs", fails, lambda m: F.floor(F.lit(orders_of) / F.bit_count(m))).alias("shapley"),
    )
