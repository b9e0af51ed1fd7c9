"""Joins beyond the built-in ones: by prefix, by range, by blocking rules, and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import written


def parent_by_prefix(df: DataFrame, code: str, lengths: Sequence[int], into: str = "parent") -> DataFrame:
    """The longest proper prefix of each code that is itself a code of df; null where there is none.

    Candidate prefixes are exploded and met with the distinct codes in one equi join, whatever the
    number of lengths; the longest that exists is an aggregate with map-side combine.
    """
    codes = df.select(F.col(code).alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    tries = F.array(*[F.when(F.length(code) > n, F.substring(code, 1, n)) for n in lengths])
    cand = df.select(code).distinct().select(code, F.explode(F.array_compact(tries)).alias("_p"))
    best = cand.join(codes, "_p").groupBy(code).agg(F.max_by("_p", F.length("_p")).alias(into))
    return df.join(best, code, "left")


def covering_range(df: DataFrame, key: str, ranges: DataFrame, low: str, high: str, payload: str, into: str) -> DataFrame:
    """The first (by low, then payload) of the integer ranges that covers each key; null where none does.

    Each range lies on the grid whose cells are the least power of two not under its width, so it
    touches two cells at most, however wide it is. Keys are looked up on each grid that has ranges (at
    most 64), so the join is an equi join on grid and cell with the bounds as a filter.
    """
    cells = ranges.select(F.col(low).cast("long").alias("_lo"), F.col(high).cast("long").alias("_hi"), F.col(payload).alias("_v")).filter("_lo <= _hi")
    cells = cells.withColumn("_grid", F.least(F.lit(63), F.ceil(F.log2(F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1))).cast("int"))
    at = lambda c: F.call_function("shiftright", c, F.col("_grid"))
    cells = cells.withColumn("_cell", F.explode(F.array_distinct(F.array(at(F.col("_lo")), at(F.col("_hi"))))))
    grids = sorted(r[0] for r in cells.select("_grid").distinct().collect())  # at most 64 numbers
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    keys = keys.withColumn("_grid", F.explode(F.array(*map(F.lit, grids)) if grids else F.array().cast("array<int>"))).withColumn("_cell", at(F.col(key).cast("long")))
    found = keys.join(cells, ["_grid", "_cell"]).filter(F.col(key).between(F.col("_lo"), F.col("_hi")))
    best = found.groupBy(key).agg(F.min(F.struct("_lo", "_v")).alias("_b")).select(key, F.col("_b._v").alias(into))
    return df.join(best, key, "left")


def largest_blocks(left: DataFrame, right: DataFrame, rules: Sequence[Sequence[str]], n: int = 5) -> DataFrame:
    """The n blocks of each rule with the most pairs: (rule, key, n_left, n_right, n_pairs)."""
    out = []
    for rule in rules:
        has = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in rule])
        count = lambda d, c: d.filter(has).groupBy(*rule).agg(F.count(F.lit(1)).alias(c))
        both = count(left, "n_left").join(count(right, "n_right"), list(rule))
        rows = both.select(F.lit("+".join(rule)).alias("rule"), F.concat_ws("+", *rule).alias("key"), "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("n_pairs"))
        out.append(rows.orderBy(F.col("n_pairs").desc(), "key").limit(n))
    return reduce(DataFrame.unionAll, out)


def block_pairs(left: DataFrame, right: DataFrame, rules: Sequence[Sequence[str]], left_id: str, right_id: str, hot: int | None = None, salts: int = 32) -> DataFrame:
    """Candidate pairs (l_id, r_id) that agree on all columns of at least one rule; a null key never agrees.

    One equi join for each rule. A rule leaves out pairs that an earlier rule has found, so each pair
    comes once without a distinct over all pairs, and rows without a rule's keys never reach its shuffle.
    Where `hot` is given, right rows of keys that have more rows are dealt over `salts` parts by their
    id, and left rows of those keys go to each part: the pairs stay the same, no task has a whole block.
    One count of all rules' keys finds them; without any, the joins are as they are without `hot`.
    """
    found = []
    cols = sorted({c for rule in rules for c in rule})
    l_all = left.select(F.col(left_id).alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in cols])
    r_all = right.select(F.col(right_id).alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in cols])
    agree = [reduce(lambda a, b: a & b, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in rule]) for rule in rules]
    salted: set[int] = set()
    if hot is not None:
        keys = [F.when(reduce(lambda a, b: a & b, [F.col(f"r_{c}").isNotNull() for c in rule]), F.struct(F.lit(k).alias("rule"), F.xxhash64(*[F.col(f"r_{c}") for c in rule]).alias("key"))) for k, rule in enumerate(rules)]
        large = r_all.select(F.explode(F.array_compact(F.array(*keys))).alias("_b")).groupBy("_b.rule", "_b.key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("rule", "key")
        large = written(large, "hot-blocks")
        salted = {r["rule"] for r in large.select("rule").distinct().collect()}  # a number for each rule
    for k, rule in enumerate(rules):
        l_has = reduce(lambda a, b: a & b, [F.col(f"l_{c}").isNotNull() for c in rule])
        r_has = reduce(lambda a, b: a & b, [F.col(f"r_{c}").isNotNull() for c in rule])
        l_rows, r_rows, on = l_all.filter(l_has), r_all.filter(r_has), agree[k]
        if k in salted:
            key = lambda side: F.xxhash64(*[F.col(f"{side}_{c}") for c in rule])  # noqa: B023, E731
            own = large.filter(F.col("rule") == k).select("key", F.lit(True).alias("_hot"))
            r_rows = r_rows.withColumn("key", key("r")).join(own, "key", "left").withColumn("_rs", F.when(F.col("_hot"), F.pmod(F.xxhash64("r_id"), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot", "key")
            l_rows = l_rows.withColumn("key", key("l")).join(own, "key", "left")
            l_rows = l_rows.withColumn("_ls", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot", "key")
            on = on & (F.col("_ls") == F.col("_rs"))
        pairs = l_rows.join(r_rows, on)
        for earlier in agree[:k]:
            pairs = pairs.filter(~F.coalesce(earlier, F.lit(False)))
        found.append(pairs.select("l_id", "r_id"))
    return reduce(DataFrame.unionAll, found)


def join_coverage(left: DataFrame, right: DataFrame, on: Mapping[str, str], keep: Column | None = None) -> DataFrame:
    """How many rows of left find a key in right: (n_rows, n_matched, ratio)."""
    keys = right.select(*[F.col(r).alias(f"_{l}") for l, r in on.items()]).distinct().withColumn("_hit", F.lit(1))
    rows = left.filter(keep) if keep is not None else left
    joined = rows.join(keys, reduce(lambda a, b: a & b, [F.col(l) == F.col(f"_{l}") for l in on]), "left")
    n, m = F.count(F.lit(1)), F.count("_hit")
    return joined.agg(n.alias("n_rows"), m.alias("n_matched"), F.try_divide(m.cast("double"), n.cast("double")).alias("ratio"))


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, count_nulls: bool = False) -> DataFrame:
    """Rows of child whose key is not in parent; rows with a null key count only on request."""
    keys = parent.select(F.col(parent_key).alias("_pk")).filter(F.col("_pk").isNotNull()).distinct()
    rows = child if count_nulls else child.filter(F.col(child_key).isNotNull())
    return rows.join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def check_foreign_keys(tables: Mapping[str, DataFrame], edges: Sequence[Mapping[str, str]]) -> tuple[dict[str, DataFrame], list[str]]:
    """Orphans of each accepted edge {child, child_key, parent, parent_key, status}, and the edges left for review."""
    run, review = {}, []
    for e in edges:
        name = f"{e['child']}.{e['child_key']}->{e['parent']}.{e['parent_key']}"
        if e.get("status", "accepted") == "accepted":
            run[name] = fk_orphans(tables[e["child"]], tables[e["parent"]], e["child_key"], e["parent_key"], count_nulls=True)
        else:
            review.append(name)
    return run, review


def foreign_key_report(tables: Mapping[str, DataFrame], edges: Sequence[Mapping[str, str]]) -> DataFrame:
    """(edge, status, orphans): accepted edges are checked and their orphans counted, null keys too; the others are for review and run nothing."""
    found, review = check_foreign_keys(tables, edges)
    rows = [df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("edge"), F.lit("checked").alias("status"), "orphans") for name, df in found.items()]
    spark = next(iter(tables.values())).sparkSession
    rows.append(spark.createDataFrame([(name, "review", None) for name in review], "edge string, status string, orphans long"))
    return reduce(DataFrame.unionAll, rows)
