"""Recursion: any depth and size, nulls, circles, empty tables; reachability against a breadth-first search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import fixpoint as fp


def searched(edges, seeds):
    seen, last = set(seeds), set(seeds)
    while last:
        last = {c for p, c in edges if p in last and c is not None} - seen
        seen |= last
    return seen - set(seeds)


@pytest.mark.parametrize("seed", range(4))
def test_reachable_in_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([40, 60, 110]))]
    edges += [(200 + k, 201 + k) for k in range(30)] + [(230, 200)]  # a circle alone
    edges += [(300, 301), (300, 302), (301, 303), (302, 303), (303, 304), (303, 305), (304, 306), (305, 306)] * 2  # nested parallel paths
    edges += [(None, 5), (7, None), (9, 9)]
    seeds = [rng.randrange(n) for _ in range(3)] + [300, 999]
    got = fp.reachable(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(s,) for s in seeds] + [(None,)], "node long"))
    assert sorted(r["node"] for r in got.collect()) == sorted(searched(edges, seeds))


def test_no_edges_and_no_seeds(spark):
    e, s = spark.createDataFrame([], "parent string, child string"), spark.createDataFrame([], "node string")
    assert fp.reachable(e, s).count() == 0
    assert fp.reachable(spark.createDataFrame([("a", "b")], "parent string, child string"), s).count() == 0


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(fp, "written", lambda df, name="table", f=fp.written: (rounds.append(name), f(df, name))[1])
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    got = fp.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert got.agg(F.count("node"), F.max("node")).first() == (n, n)
    assert rounds.count("pointers") <= 15 and len(rounds) <= 24


def test_rows_and_depth_without_limit(spark):
    base = spark.range(2_000_000).select(F.col("id").alias("k"), F.lit(0).alias("depth"))
    got = fp.fixpoint(base, lambda last: last.filter("depth < 2 AND k % 2 = 0").selectExpr("k DIV 2 AS k", "depth + 1 AS depth"), distinct=False)
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 2_000_000), (1, 1_000_000), (2, 500_000)]
    deep = fp.fixpoint(spark.createDataFrame([(1,)], "n int"), lambda last: last.filter("n < 120").selectExpr("n + 1 AS n"))
    assert deep.agg(F.count("n"), F.max("n")).first() == (120, 120)


def test_distinct_rows_keys_and_nulls(spark):
    base = spark.createDataFrame([(1, None), (1, None), (2, "a"), (None, "b")], "k int, v string")
    circle = lambda last: last.selectExpr("v", "(k + 1) % 3 AS k")
    got = {tuple(r) for r in fp.fixpoint(base, circle).collect()}
    assert got == {(k, v) for k in range(3) for v in (None, "a")} | {(None, "b")}
    assert fp.fixpoint(base, circle).count() == len(got)
    first = fp.fixpoint(spark.createDataFrame([(1, 10)], "k int, cost int"), lambda last: last.selectExpr("k % 4 + 1 AS k", "cost + 1 AS cost"), keys=["k"])
    assert sorted(tuple(r) for r in first.collect()) == [(1, 10), (2, 11), (3, 12), (4, 13)]
    assert fp.fixpoint(base.limit(0), circle).count() == 0
    with pytest.raises(RecursionError):
        fp.fixpoint(spark.createDataFrame([(1,)], "n int"), lambda last: last.selectExpr("n + 1 AS n"), most_rounds=3)
