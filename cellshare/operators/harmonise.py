"""Attribute harmonisation: schema mapping, null tokens, code lookups, ids."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What reads as missing in code tables; the text NA is a code and stays.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Columns of the layers, in order, with their types.
BASE_SCHEMA = {"ID": "string", "NAME": "string", "ISO3_CODE": "string", "ISO2_CODE": "string", "ISON_CODE": "string", "NUM_ID": "bigint"}
COUNTRIES_SCHEMA = BASE_SCHEMA | {"NE_ID": "bigint", "SOURCE": "string"}
SEAS_SCHEMA = BASE_SCHEMA | {"OL_NAME": "string", "SOURCE": "string"}
WORLD_BANK_SCHEMA = BASE_SCHEMA | {"WB_A3": "string", "HASC_0": "string", "WB_REGION": "string", "WB_STATUS": "string", "SOVEREIGN": "string", "SOURCE": "string"}

#: Source column to layer column.
COLUMN_MAPS = {
    "natural_earth_countries": {"NAME_LONG": "NAME", "ISO_A3": "ISO3_CODE", "ISO_A2": "ISO2_CODE", "ISO_N3": "ISON_CODE", "NE_ID": "NE_ID"},
    "natural_earth_seas": {"parent_reg": "NAME", "ne_id": "NE_ID"},
    "eurostat": {"NAME_ENGL": "NAME", "CNTR_NAME": "OL_NAME", "ISO3_CODE": "ISO3_CODE", "CNTR_ID": "ID"},
    "goas": {"name": "NAME"},
    "seavox": {"SUB_REGION": "NAME"},
    "world_bank": {"NAM_0": "NAME", "ISO_A3": "ISO3_CODE", "ISO_A2": "ISO2_CODE", "WB_A3": "WB_A3", "WB_REGION": "WB_REGION", "WB_STATUS": "WB_STATUS", "SOVEREIGN": "SOVEREIGN"},
}
SOURCES = {
    "natural_earth_countries": "Natural Earth Admin0 10m",
    "natural_earth_seas": "Natural Earth Oceans 10m",
    "eurostat": "EUROSTAT",
    "goas": "GOAS v1",
    "seavox": "SeaVox v19",
    "world_bank": "World Bank Official Boundaries",
}


def prepare(table: DataFrame, schema: Mapping[str, str], column_map: Mapping[str, str], fixed: Mapping[str, object] | None = None, restrict: bool = True) -> DataFrame:
    """Rename, add missing columns as null, set fixed values, select in the schema's order, geometry last.

    Without ``restrict`` a source column that isn't mapped but carries a name of the schema survives.
    """
    named = {target: source for source, target in column_map.items() if source in table.columns}
    out = []
    for c, kind in schema.items():
        if fixed and c in fixed:
            v = F.lit(fixed[c])
        elif c in named:
            v = F.col(named[c])
        elif not restrict and c in table.columns:
            v = F.col(c)
        else:
            v = F.lit(None)
        out.append(v.cast(kind).alias(c))
    return table.select(*out, *[c for c in ("geometry", "row_id") if c in table.columns])


def null_tokens(table: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """String columns with the tokens read as null."""
    return table.select(*[F.when(F.col(c).isin(*tokens), None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in table.dtypes])


def sentinel_to_null(table: DataFrame, columns: list[str], sentinel: str = "-99") -> DataFrame:
    return table.withColumns({c: F.when(F.col(c).cast("string") != sentinel, F.col(c)) for c in columns})


def to_number(text: Column) -> Column:
    """Text such as ``" 20.0 "`` to a whole number; anything else is null."""
    v = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 9.2e18), v).cast("bigint")


def first_by(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each non-null key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return table.filter(F.col(key).isNotNull()).withColumn("_r", rank).filter("_r = 1").drop("_r")


def lookup(table: DataFrame, codes: DataFrame, on: str, key: str, value: str, into: str, order: str | None = None) -> DataFrame:
    """``into`` = the code table's ``value`` where ``key`` equals ``on``; null if there is none; rows keep their number."""
    side = codes.select(F.col(key).alias("_k"), F.col(value).alias("_v"), *([F.col(order).alias("_o")] if order else []))
    side = first_by(side, "_k", "_o").drop("_o") if order else side.filter("_k is not null")
    if not order and side.groupBy("_k").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} isn't unique")
    return table.join(side, table[on] == F.col("_k"), "left").withColumn(into, F.col("_v")).drop("_k", "_v")


def iso_dimension(codes: DataFrame) -> DataFrame:
    """``alpha3, alpha2, numeric`` from a code table; the first row of an alpha-3 code counts."""
    one = first_by(codes, "iso3_code", "num_id")
    return one.select(F.col("iso3_code").alias("alpha3"), F.col("iso2_code").alias("alpha2"), F.lpad(to_number(F.col("ison_code")).cast("string"), 3, "0").alias("numeric"))


def enrich_iso(table: DataFrame, iso: DataFrame, iso2: bool = True) -> DataFrame:
    """ISO codes from ISO3_CODE, over what the layer had."""
    out = table.join(iso, table["ISO3_CODE"] == F.col("alpha3"), "left").withColumn("ISON_CODE", F.col("numeric"))
    return (out.withColumn("ISO2_CODE", F.col("alpha2")) if iso2 else out).drop("alpha3", "alpha2", "numeric")


def sea_id(name: Column) -> Column:
    """``OC_`` and the initials; one name has a shorter id."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    full = F.concat(F.lit("OC_"), F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""))
    return F.when(full == "OC_SCAEAS", "OC_SCS").otherwise(full)


def dictionary_join(table: DataFrame, names: DataFrame, on: str, name: str, parent: str, into: str, default: str = "Other") -> DataFrame:
    """``into`` = the parent of the lower-case name, or the default; of a name's several parents the first by name."""
    side = names.select(F.lower(name).alias("_k"), F.col(parent).alias("_v")).filter("_k is not null").groupBy("_k").agg(F.min("_v").alias("_v"))
    return table.join(side, F.lower(table[on]) == F.col("_k"), "left").withColumn(into, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def union_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name with nulls where a column is absent; differing columns are logged."""
    if a.columns != b.columns:
        logging.getLogger(__name__).warning("columns differ: %s", sorted(set(a.columns) ^ set(b.columns)))
    return a.unionByName(b, allowMissingColumns=True)


def same_crs(a: str, b: str, strict: bool = True) -> bool:
    """Whether two layers have one reference system; raises if they must."""
    if a != b:
        if strict:
            raise ValueError(f"reference systems differ: {a}, {b}")
        logging.getLogger(__name__).warning("reference systems differ: %s, %s", a, b)
    return a == b


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null doesn't delete."""
    return table.filter(~F.coalesce(condition, F.lit(False)))
