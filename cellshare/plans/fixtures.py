"""Deterministic stand-ins for boundary layers, made from the relational tables; the same text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions)
EXPRESSIONS = {
    "fx_tiles": ("nation", [
        "concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS region_id", "CAST(n_regionkey AS BIGINT) AS grp",
        "CAST((n_nationkey % 5) * 6 AS DOUBLE) AS minx", "CAST(floor(n_nationkey / CAST(5.0 AS DOUBLE)) * 3 AS DOUBLE) AS miny",
        "CAST((n_nationkey % 5) * 6 + 6 AS DOUBLE) AS maxx", "CAST(floor(n_nationkey / CAST(5.0 AS DOUBLE)) * 3 + 3 AS DOUBLE) AS maxy",
        "CAST(n_nationkey AS BIGINT) AS row_id",
    ]),
    "fx_boxes": ("nation", [
        "concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS region_id", "CAST(n_regionkey AS BIGINT) AS grp",
        "CAST((n_nationkey * 5) % 24 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (n_nationkey % 4) AS minx",
        "CAST((n_nationkey * 3) % 11 AS DOUBLE) + CAST(0.125 AS DOUBLE) * (n_nationkey % 8) AS miny",
        "CAST((n_nationkey * 5) % 24 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (n_nationkey % 4) + 2 + CAST(0.5 AS DOUBLE) * (n_nationkey % 5) AS maxx",
        "CAST((n_nationkey * 3) % 11 AS DOUBLE) + CAST(0.125 AS DOUBLE) * (n_nationkey % 8) + CAST(1.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (n_nationkey % 7) AS maxy",
        "CAST(n_nationkey AS BIGINT) AS row_id",
    ]),
    "fx_parcels": ("customer", [
        "concat('C', CAST(c_custkey AS STRING)) AS region_id", "CAST(c_nationkey AS BIGINT) AS grp",
        "CAST((c_custkey * 7) % 240 AS DOUBLE) / CAST(8.0 AS DOUBLE) AS minx", "CAST((c_custkey * 13) % 112 AS DOUBLE) / CAST(8.0 AS DOUBLE) AS miny",
        "CAST((c_custkey * 7) % 240 + 4 + c_custkey % 9 AS DOUBLE) / CAST(8.0 AS DOUBLE) AS maxx", "CAST((c_custkey * 13) % 112 + 3 + c_custkey % 7 AS DOUBLE) / CAST(8.0 AS DOUBLE) AS maxy",
        "CAST(c_custkey AS BIGINT) AS row_id",
    ]),
    "fx_codes": ("nation", [
        "CASE WHEN n_nationkey = 7 THEN 'NA' ELSE concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS id", "n_name AS name",
        "CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE concat(CAST(1159320000 + n_nationkey AS STRING), '.0') END AS ne_id",
        "CASE WHEN n_nationkey % 7 = 6 THEN 'N/A' ELSE concat('C', lpad(CAST(n_nationkey % 20 AS STRING), 2, '0')) END AS iso3_code",
        "CASE WHEN n_nationkey % 9 = 8 THEN '' ELSE concat(CAST(n_nationkey * 4 AS STRING), '.0') END AS ison_code",
        "CAST(n_nationkey + 1 AS BIGINT) AS num_id",
    ]),
    "fx_obs": ("events", [
        "event_id AS obs_id", "CAST((user_id * 37) % 120 AS DOUBLE) / CAST(4.0 AS DOUBLE) AS lon",
        "CAST((event_id * 11) % 60 AS DOUBLE) / CAST(4.0 AS DOUBLE) AS lat", "value",
    ]),
    "fx_sites": ("supplier", [
        "CAST(s_suppkey AS BIGINT) AS site_id", "CAST((s_suppkey * 7) % 120 AS DOUBLE) / CAST(4.0 AS DOUBLE) AS x",
        "CAST((s_suppkey * 13) % 64 AS DOUBLE) / CAST(4.0 AS DOUBLE) AS y",
    ]),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = EXPRESSIONS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def sql(body: str) -> str:
    """``body`` with the stand-ins that it names as common tables."""
    used = [f"{n} AS (SELECT {', '.join(e)} FROM {t})" for n, (t, e) in EXPRESSIONS.items() if n in body]
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.lstrip().startswith(head):
            return head + ", ".join([*used, body.lstrip()[len(head) :]])
    return (f"WITH {', '.join(used)} " if used else "") + body
