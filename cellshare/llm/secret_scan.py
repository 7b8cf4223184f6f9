"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query: the strings that each stretch of it must
spell give conjunctions of trigrams, alternatives give disjunctions.  The index lists, for every trigram that
some query asks for, the rows whose text (lower case) holds it.  Postings of a conjunction are intersected by
counting, and only candidate rows are verified with the expression; a rule without mandatory trigrams scans all
rows.

Positions come without Python: the lengths of what lies between matches and of the matches themselves, summed
in order, are code points.  All rules are verified in one pass, each on the rows that are its candidates.  A row is
known by a 128-bit hash of its id and text; rows alike in both have the same result.

Null and empty texts have no matches; every row of the table has a result, null ids and repeated ids included.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BROADCAST_ROWS = 200_000
KEY = ["k0", "k1"]
MAX_STRINGS = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in their listed order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the index makes cheap to look for besides.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


# ------------------------------------------------------------------------------------- trigram queries
Query = list[frozenset[str]]  # a disjunction of conjunctions; [frozenset()] is always true


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _or(strings: set[str]) -> Query:
    parts = {_trigrams(s) for s in strings}
    return [p for p in parts if not any(o < p for o in parts)]


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_STRINGS:  # the weaker one alone stays true
        return min(a, b, key=len)
    parts = {x | y for x in a for y in b}
    return [p for p in parts if not any(o < p for o in parts)]


def _spelled(item) -> set[str] | None:
    """All strings an element can match, in lower case, or None if they are many."""
    op, arg = item
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for kind, v in arg:
            if kind is rc.LITERAL:
                out.add(chr(v).lower())
            elif kind is rc.RANGE and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is rc.SUBPATTERN:
        return _strings(arg[-1])
    if op is rc.BRANCH:
        parts = [_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] == 1 and arg[0] in (0, 1):
        inner = _strings(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _strings(items) -> set[str] | None:
    now = {""}
    for item in items:
        s = _spelled(item)
        if s is None or len(now) * len(s) > MAX_STRINGS:
            return None
        now = {a + b for a in now for b in s}
    return now


def _derive(items) -> Query:
    query, now = [frozenset()], {""}
    for item in items:
        s = _spelled(item)
        if s is not None and len(now) * len(s) <= MAX_STRINGS:
            now = {a + b for a in now for b in s}
            continue
        query, now, (op, arg) = _and(query, _or(now)), {""}, item
        if s is not None:
            now = s
        elif op is rc.SUBPATTERN:
            query = _and(query, _derive(arg[-1]))
        elif op is rc.BRANCH:
            parts = {p for alternative in arg[1] for p in _derive(alternative)}
            query = _and(query, [p for p in parts if not any(o < p for o in parts)])
        elif op is rc.MAX_REPEAT and arg[0] >= 1:
            query = _and(query, _derive(arg[2]))
    return _and(query, _or(now))


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams of which one must be in any matching text whole; an empty set if nothing is mandatory."""
    query = _derive(parser.parse(pattern))
    return [frozenset()] if any(not q for q in query) else sorted(query, key=sorted)


# --------------------------------------------------------------------------------------------- index
def row_key(id_col: str, text_col: str) -> list[Column]:
    """``k0, k1``: two hashes of 64 bits."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k0"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("k1")]


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in s)


def postings(docs: DataFrame, trigrams: set[str], text_col: str = "text") -> DataFrame:
    """``trigram, k0, k1``: the rows that hold each of the trigrams."""
    by: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by.setdefault(t[0], []).append(t[1:])
    one = "|".join(f"{_quoted(a)}(?:{'|'.join(map(_quoted, rest))})" for a, rest in by.items())
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(f"(?s)(?=({one}))"), F.lit(1)))
    return docs.select(*KEY, F.explode(found).alias("trigram")).select("trigram", *KEY)


def candidates(index: DataFrame, rules: list[tuple[Rule, Query]]) -> DataFrame:
    """``k0, k1, kinds``: rows that hold all trigrams of one conjunction of a rule; rows that share a key count each once."""
    rows = [(t, r.kind, n, len(q)) for r, query in rules for n, q in enumerate(query) for t in q]
    # one row for each trigram of each rule: as small as the rules
    terms = index.sparkSession.createDataFrame(rows, "trigram string, kind string, part int, size int")
    held = index.join(F.broadcast(terms), "trigram").groupBy(*KEY, "kind", "part", "size").agg(F.count_distinct("trigram").alias("n"))
    return held.filter("n = size").groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))


# ------------------------------------------------------------------------------------------- verify
def _pieces(rule: Rule, asked: Column | None) -> Column:
    """Each match of a text and the length of what lies before it; none where ``asked`` doesn't hold."""
    hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x))
    each = F.transform(F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")), lambda m, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["hit"].alias("hit")))
    found = F.col("text").rlike(rule.pattern if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}")
    return F.when(found if asked is None else asked & found, each).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string>>"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k0, k1, kind, start, end``: all matches that count, in code points, the end exclusive."""
    own = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    queries = [(r, trigram_query(r.pattern)) for r in rules]
    indexed = [(r, q) for r, q in queries if all(q)]
    if indexed:
        index = C.materialise(postings(own, set().union(*(t for _, q in indexed for t in q))), "postings")
        found = C.materialise(candidates(index, indexed), "candidates")
        # else the texts move, once for all rules
        own = own.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, KEY, "left")
    parts = [_pieces(r, F.array_contains("kinds", r.kind) if all(q) else None) for r, q in queries]
    every = own.select(*KEY, F.explode(F.concat(*parts)).alias("m")).select(*KEY, "m.kind", "m.i", "m.gap", "m.hit")
    # rows alike in id and text give the same pieces
    every = every.dropDuplicates([*KEY, "kind", "i"])
    order = Window.partitionBy(*KEY, "kind").orderBy("i")
    placed = every.withColumn("step", F.col("gap") + F.coalesce(F.lag(F.length("hit")).over(order), F.lit(0)))
    placed = placed.withColumn("start", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts = F.lit(False)
    for r in rules:
        size = F.length(F.regexp_extract("hit", r.pattern, r.group)) if r.group else F.length("hit")
        counts = counts | ((F.col("kind") == r.kind) & (size >= r.least))
    return placed.filter(counts).select(*KEY, "kind", "start", (F.col("start") + F.length("hit")).alias("end"))


def digest(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its numbers of base matches, the hash of the base spans and all spans as a string."""
    place = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    one = F.struct("start", place[F.col("kind")].alias("place"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    base = [r.kind for r in rules[:3]]
    rows = found.groupBy(*KEY).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base], F.collect_list(F.when(F.col("kind").isin(base), one)).alias("base"), F.collect_list(one).alias("all"))
    own = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col))
    out = own.join(rows, KEY, "left")
    text = lambda c: F.coalesce(listed(c), F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base], F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"))
