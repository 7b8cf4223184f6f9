"""The pipeline's stages on the smallest tables, each against its own brute force, and the SQL twins."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from cellshare.llm import common, decontaminate, packing, queries, toxicity

from .test_operators import awkward, brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    one = common.materialise(steps["toxicity"](spark, docs, SF))
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.classify(docs, model).collect() if r.predicted}
    assert {i for i, _ in rows(one)} == {i for i, _ in rows(docs)} - rejected

    two = common.materialise(steps["line_dedup"](spark, one, SF))
    kept = brute_lines(rows(one))
    before = dict(rows(one))
    assert dict(rows(two)) == {i: t for i, t in kept.items() if t == before[i] or t.replace("\n", "").strip(" ")}

    three = common.materialise(steps["ngram_jaccard_join"](spark, two, SF))
    assert sorted(i for i, _ in rows(three)) == sorted(i for i, _, c in brute_components(rows(two)) if i == c)

    four = common.materialise(steps["benchmark_decontamination"](spark, three, SF))
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    patterns = [(decontaminate.Pattern(i), decontaminate.budget(i)) for i in items]
    clean = [i for i, t in rows(three) if not any(p.distance(decontaminate.normal(t), b) <= b for p, b in patterns)]
    assert sorted(i for i, _ in rows(four)) == sorted(clean)
    assert docs.columns == one.columns == two.columns == three.columns == four.columns

    five = steps["packing"](spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(clean)
    filled = {}
    for r in five:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= packing.CAPACITY and sum(packing.CAPACITY - f for f in filled.values()) < 2 * packing.CAPACITY


def test_stages_awkward(spark):
    """Every stage on nulls, ties, repeated rows, very long texts and clashing columns, and on no rows at all."""
    docs = awkward(spark).selectExpr("*", "cast(length(text) as int) as n_chars")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, none, SF).count() == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(columns).collect())
    assert got == sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_queries_are_registered():
    import __spark_entry__ as E

    assert {f"op{n}_" for n in range(1, 11)} == {f"{k.split('_')[0]}_" for k in E.queries() if k.startswith("op")}
    assert "pipeline" in E.queries()
