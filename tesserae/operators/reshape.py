"""Set operations and changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rowset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two tables hold a different number of times: the row, n_a and n_b; one shuffle."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*cols).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b")).filter("n_a != n_b")


def pivot_sum(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str] | None, measure: str) -> DataFrame:
    """Sums of a measure with one column for each value; give the values where they are known, to spare a job."""
    grouped = df.groupBy(*keys)
    return (grouped.pivot(on, list(values)) if values else grouped.pivot(on)).agg(F.sum(measure))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """All rows, columns aligned by name, absent ones null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of source in place of those with the same keys, and source's new ones."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def listed(col: str | Column, sep: str = ",") -> Column:
    """Aggregate: all distinct values of a group in order, joined; the result holds them all, so groups must be small."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def first_values(df: DataFrame, keys: Sequence[str], col: str, n: int = 5, sep: str = ", ", into: str = "examples") -> DataFrame:
    """The first n distinct values of a column in order, joined: (keys, into), or one row without keys where there is any value.

    Values are made distinct and ranked, of which each task sends n of a group at most, before n are
    gathered; so no group is gathered whole.
    """
    rows = df.select(*keys, F.col(col).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    if keys:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).filter(F.col("_r") <= n)
    else:
        rows = rows.orderBy("_v").limit(n)
    joined = F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(into)
    return rows.groupBy(*keys).agg(joined) if keys else rows.agg(joined)
