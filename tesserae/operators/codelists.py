"""Code lists: levels from the shape of a code, parents, the uniform list shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.exprs import stamp
from tesserae.operators.joins import covering_range, parent_by_prefix

# Names of industry levels by code length.
LEVEL_NAMES = {2: "sector", 3: "subsector", 4: "industry_group", 5: "naics_industry", 6: "national_industry"}


def industry_level(code: Column) -> Column:
    """1 for two digits or a range of sectors, else one less than the length."""
    return F.when(code.contains("-") | (F.length(code) == 2), 1).otherwise(F.length(code) - 1)


def industry_level_name(code: Column) -> Column:
    named = F.coalesce(*[F.when(F.length(code) == n, F.lit(name)) for n, name in LEVEL_NAMES.items()])
    return F.when(code.contains("-"), "sector").otherwise(named)


def diagnosis_level(code: Column) -> Column:
    return F.length(code) - 2


def industry_list(raw: DataFrame, as_of: str | None = None) -> DataFrame:
    """(code, title, level, parent, as_of) of raw (code, title).

    Sectors are roots; a three-digit code hangs off the sector that is or covers its first two digits,
    a deeper one off itself without its last digit. Trailing T and * markers of titles go.
    """
    rows = raw.select("code", F.regexp_replace("title", r"[T*]+\z", "").alias("title"), industry_level(F.col("code")).cast("int").alias("level"))
    low = F.substring_index("code", "-", 1).try_cast("int")
    high = F.substring_index("code", "-", -1).try_cast("int")
    sectors = rows.filter("level = 1").select("code", low.alias("_lo"), high.alias("_hi")).filter("_lo IS NOT NULL AND _hi IS NOT NULL")
    keyed = rows.withColumn("_two", F.when(F.length("code") == 3, F.substring("code", 1, 2).try_cast("int")))
    hung = covering_range(keyed, "_two", sectors, "_lo", "_hi", "code", "_sector")
    code = F.col("code")
    parent = F.when(F.col("level") == 1, None).when(F.length(code) == 3, F.col("_sector")).otherwise(F.substr(code, F.lit(1), F.length(code) - 1))
    return stamp(hung.select("code", "title", "level", parent.alias("parent")), as_of)


def diagnosis_list(raw: DataFrame, as_of: str | None = None, longest: int = 7) -> DataFrame:
    """(code, title, level, parent, as_of) of raw (code, title): the parent is the longest shorter prefix that is a code."""
    hung = parent_by_prefix(raw.select("code", "title"), "code", list(range(3, longest)))
    return stamp(hung.select("code", "title", diagnosis_level(F.col("code")).cast("int").alias("level"), "parent"), as_of)
