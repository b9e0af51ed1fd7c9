"""Ranking, de-duplication, scaling and sampling without single-partition windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import written


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by a total order; state null order in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def tie_size(df: DataFrame, cols: Sequence[str], into: str = "n_equiv") -> DataFrame:
    """How many rows share the values of cols."""
    return df.withColumn(into, F.count(F.lit(1)).over(Window.partitionBy(*cols)))


def rank_global(df: DataFrame, order: Sequence[Column], into: str = "rank") -> DataFrame:
    """1, 2, 3, … by a total order: rows are range-partitioned and ranked inside, and each partition starts after those before it.

    The sorted rows are written once, so that the counts and the ranks come from the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    at = written(at, "ranges")
    counts = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = counts.select("_p", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return at.withColumn("_r", within).join(F.broadcast(starts), "_p").withColumn(into, F.col("_start") + F.col("_r")).drop("_p", "_r", "_start")


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Each column scaled to 0..1 by the table's least and largest value; 0 where all are equal or the value is null."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    out = df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c + suffix, F.coalesce(F.try_divide((F.col(c) - lo).cast("double"), (hi - lo).cast("double")), F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


#: Bits of a hash that one count of ranges tells apart, and rows that the last range is sorted with.
RANGE_BITS, LAST_ROWS = 16, 10_000


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows with the smallest seeded hashes of a key, all if there are fewer: the same rows whatever the layout.

    Rows of equal hashes follow each other by a hash of all their columns. The n-th hash is found from counts by hash
    range, at most 2**RANGE_BITS of which reach the driver at a time: ranges below it go whole, and the one that holds
    it is counted again more finely until it has LAST_ROWS rows at most, which alone are sorted. Of rows that are equal
    in all columns any will do, as they are one another's copies. No task gets all n rows.
    """
    if n < 1:
        return df.limit(0)
    flip = F.lit(-(1 << 63)).cast("long")  # signed order as unsigned ranges
    rows = df.withColumns({"_h0": F.xxhash64(F.col(f"`{key}`"), F.lit(seed)).bitwiseXOR(flip), "_h1": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)).bitwiseXOR(flip)})
    taken, left, place = [], n, F.lit(True)
    for k in range(128 // RANGE_BITS):
        bits = F.shiftrightunsigned(f"_h{k * RANGE_BITS // 64}", 64 - RANGE_BITS - k * RANGE_BITS % 64).bitwiseAND(F.lit((1 << RANGE_BITS) - 1).cast("long"))
        at, count = None, 0
        for r in sorted(rows.filter(place).groupBy(bits.alias("range")).count().collect()):  # at most 2**RANGE_BITS
            if r["count"] >= left:
                at, count = r["range"], r["count"]
                break
            left -= r["count"]
        if at is None:
            taken.append(place)
            left = 0
            break
        taken.append(place & (bits < at))
        place = place & (bits == at)
        if count <= LAST_ROWS or count == left:
            break
    whole = rows.filter(reduce(lambda a, b: a | b, taken))
    if left:
        last = rows.filter(place)
        whole = whole.unionByName(last if count == left else last.orderBy("_h0", "_h1").limit(left))
    return whole.drop("_h0", "_h1")


def surrogate_id(df: DataFrame, natural: Sequence[str], into: str = "row_id") -> DataFrame:
    """A row id that follows from the natural key alone."""
    return df.withColumn(into, F.sha2(F.to_json(F.struct(*natural), {"ignoreNullFields": "false"}), 256))


def assert_total_order(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values of cols that several rows share: no rows if the order by them is total."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def retain_newest(df: DataFrame, key: str, order: Sequence[Column], n: int = 50) -> DataFrame:
    """The newest n rows of each key; older ones go."""
    return best_per_key(df, [key], order, n)
