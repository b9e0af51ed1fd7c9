"""Trend ranking from counts over a recent and a longer window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import thousands
from tesserae.operators.windows import minmax_scale, rank_global


def install_events(files: DataFrame, json_col: str = "formulae", path_col: str = "path") -> DataFrame:
    """Rows (window, name, installs) of JSON maps of arrays of objects; the window is the number in `…/30d.json`."""
    items = F.flatten(F.map_values(F.from_json(json_col, "map<string,array<map<string,string>>>")))
    rows = files.withColumn("_i", F.explode(items)).withColumn("window", F.concat(F.lit("d"), F.regexp_extract(path_col, r"(\d+)d\.json", 1)))
    name = F.coalesce(F.col("_i")["cask"], F.col("_i")["formula"])
    return rows.select(*[c for c in files.columns if c not in (json_col, path_col)], "window", name.alias("name"), thousands(F.col("_i")["count"]).alias("installs"))


def trend_measures(counts: DataFrame, threshold: float = 10, recent: str = "d30", longer: str = "d90") -> DataFrame:
    """counts with averages, trend index, both scaled to 0..1, and the distance to (1, 1).

    The index is the daily average of the 60 days before the recent 30 over that of the recent 30, and
    0 under the threshold. A column whose values are all equal scales to 0.
    """
    r, a = F.col(recent).cast("double"), F.col(longer).cast("double")
    out = counts.withColumns({"d30_avg": F.coalesce(r / 30, F.lit(0.0)), "p60_avg": F.coalesce((a - r) / 60, F.lit(0.0))})
    out = out.withColumn("trend_index", F.when(F.col("d30_avg") < threshold, 0.0).otherwise(F.coalesce(F.try_divide("p60_avg", "d30_avg"), F.lit(0.0))))
    out = minmax_scale(out, ["trend_index", recent])
    dx, dy = F.lit(1.0) - F.col("trend_index_scaled"), F.lit(1.0) - F.col(f"{recent}_scaled")
    return out.withColumn("distance", F.sqrt(dx * dx + dy * dy))


def ranking(measures: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """Measures with their details, ranked by distance, then by keys."""
    joined = measures.join(details, keys, "left")
    return rank_global(joined, [F.col("distance").asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]])
