"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import common as C

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score

    return score(C.documents(spark, sf_dir)).drop("n_bytes")


def op2_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import dedup

    out = dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
low AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE doc_id > d),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def op5_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import dedup

    out = dedup(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op5_long_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only later copies of runs of 30 characters go."""
    from .line_runs import dedup

    out = dedup(C.documents(spark, sf_dir), min_chars=30)
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


# stretches of every length that occur again; of a later copy the longest counts
_OP5 = """
WITH RECURSIVE l AS (SELECT doc_id, i, ls[i] AS line FROM (
           SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
           SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
full_ AS (SELECT doc_id, i, line, md5(line) AS h, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l WHERE trim(line) <> ''),
r AS (SELECT 1 AS n, doc_id, i, h FROM (SELECT doc_id, i, h, count(*) OVER (PARTITION BY h) AS c FROM full_) WHERE c > 1
      UNION ALL
      SELECT n, doc_id, i, h FROM (
          SELECT n, doc_id, i, h, count(*) OVER (PARTITION BY h) AS c FROM (
              SELECT r.n + 1 AS n, r.doc_id, r.i, md5(r.h || f.h) AS h FROM r JOIN full_ f ON f.doc_id = r.doc_id AND f.i = r.i + r.n)) WHERE c > 1),
longest AS (SELECT doc_id, i, max(n) AS n FROM (
            SELECT n, doc_id, i, row_number() OVER (PARTITION BY n, h ORDER BY doc_id, i) AS k FROM r) WHERE k > 1 GROUP BY doc_id, i),
run AS (SELECT x.doc_id, x.i, x.n FROM longest x JOIN full_ a ON a.doc_id = x.doc_id AND a.i = x.i
        JOIN full_ b ON b.doc_id = x.doc_id AND b.i = x.i + x.n - 1 WHERE b.upto - a.upto + length(a.line) >= 30),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM run),
m AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS r FROM (
      SELECT doc_id, i - lag(i, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) <> 1 AS first FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_lines, coalesce(m.n, 0) AS n_deleted, coalesce(m.r, 0) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

# a run of two lines repeats only if each of its lines does
_OP5_EVERY = """
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (
           SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
           SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM l WHERE trim(line) <> '') WHERE n > 1),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first) AS r FROM (
      SELECT doc_id, i - lag(i, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) <> 1 AS first FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(total.n, 0) AS n_lines, coalesce(n.n, 0) AS n_deleted, coalesce(n.r, 0) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def op6_adaptive_scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, spans

    docs = C.documents(spark, sf_dir)
    return digest(docs, spans(docs))


def _op7() -> str:
    from .secret_scan import RULES

    def kind(n: int, r) -> str:
        p = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(h, '{p}', {r.group}))" if r.group else "length(h)"
        return f"""SELECT doc_id, {n} AS place, '{r.kind}' AS kind, s, s + length(h) AS e FROM (
            SELECT doc_id, hs[i] AS h, list_sum(list_transform(gs[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS s
            FROM (SELECT doc_id, hs, gs, unnest(range(1, len(hs) + 1)) AS i FROM (
                  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS hs,
                         string_split_regex(coalesce(text, ''), '{p}') AS gs FROM documents
                  WHERE regexp_matches(text, '{p if r.kind != "hex" else "[0-9a-f]{24,}"}')))) WHERE {size} >= {r.least}"""

    every = " UNION ALL ".join(kind(n, r) for n, r in enumerate(RULES))
    word = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH m AS ({every}), g AS (SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg({word}, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg({word}, ',' ORDER BY s, place) AS every
        FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(C.documents(spark, sf_dir))[0]


_OP8 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT edge.y, r.c FROM r JOIN edge ON edge.x = r.doc_id WHERE r.c < edge.y)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def op4_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import read, write
    from .tokens import tokenizer_path

    path = f"{C.shared_dir(spark)}/token_ids"
    write(C.documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end=0)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import tokenizer_path

    return pack(C.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=1).drop("ids")


def op10_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, crc_of, train

    docs = C.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    return classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align
    from .tokens import tokenizer_path

    return align(C.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(C.documents(spark, sf_dir)).drop("fp")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_OP13 = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
f AS (SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
          || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
          doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS past FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS own, fails = x AS alone,
             len(list_intersect(string_split(fails, ''), string_split(past, ''))) > 0 AND past <> '' AND fails <> '' AS gone FROM g, s),
q AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
             coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM q"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_context_tree_weighting, op2_pigeonhole_decontamination, op3_superkmer_dedup, op4_huffman_token_ids, op5_suffix_array_line_dedup, op5_long_run_dedup, op6_adaptive_scan_neighbours, op7_trigram_secret_scan, op8_ngram_jaccard, op9_bin_slack_packing, op10_zstd_toxicity, op11_segment_alignment, op12_simhash_balls, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_superkmer_dedup": _OP3, "op5_suffix_array_line_dedup": _OP5_EVERY, "op5_long_run_dedup": _OP5, "op7_trigram_secret_scan": _op7(), "op8_ngram_jaccard": _OP8, "op13_filter_audit": _OP13}
