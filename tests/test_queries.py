"""Every query of the inventory against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cellshare.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({Q.ORACLE[name]})").fetchall()
    assert plain(got) == plain(want)


def test_dense_mask_has_every_region(spark):
    regions = {r.region_id for r in Q.load(spark, SF, "fx_boxes").select("region_id").collect()}
    n = {r.region_id: r["count"] for r in Q.QUERIES["a9_dense_mask_all_regions"](spark, SF).groupBy("region_id").count().collect()}
    assert len(regions) == 25 and n == dict.fromkeys(regions, 16 * 32)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 25
    assert set(E.oracle_sql()) <= set(E.queries())
