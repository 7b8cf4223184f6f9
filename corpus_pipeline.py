"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the stage before it kept, is written as Parquet and read again.  All but the last
return the columns of ``documents``:

1. toxicity: documents that the compression-distance model rejects go;
2. line dedup: later copies of repeated line runs are cut, a document without anything left goes;
3. n-gram Jaccard join: of each group of near-duplicates the smallest id stays;
4. decontamination: documents that hold a benchmark item within its edit budget go;
5. packing: what is left is cut and packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellshare.llm import common, decontaminate, jaccard, line_runs, packing, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_runs.stage),
    ("ngram_jaccard_join", jaccard.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Dictionaries, edit distance and bin packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
