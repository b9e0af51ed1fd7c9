"""Recursion over DataFrames: semi-naive fixed points of any depth and size, and reachability by contraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import fresh_path, written

Step = Callable[[DataFrame], DataFrame]


def fixpoint(base: DataFrame, step: Step, distinct: bool = True, keys: Sequence[str] | None = None, most_rounds: int | None = None) -> DataFrame:
    """All rows that `base`, and `step` applied to what each round has found, give, until a round finds nothing.

    As a recursive query: step sees the rows of the round before alone. With distinct, rows known already are not found
    again (UNION); they are known by `keys`, or by all columns, nulls equal; of rows with equal keys in a round one
    stays. Without, every row counts as often as it is found (UNION ALL), and step must run dry by itself. Each round is
    a written table below one folder, so that a round repeats no earlier one, the plan doesn't grow with the depth, and
    lost executors cost a round at most. Neither rows nor rounds have a limit but most_rounds, beyond which it raises.
    step must return the columns of base, in any order; they are cast to base's types.
    """
    spark = base.sparkSession
    names = base.columns
    by = list(keys or names)
    path = fresh_path(spark, "fixpoint")

    def put(rows: DataFrame, number: int) -> DataFrame:
        at = f"{path}/round-{number:09d}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in base.schema.fields]).write.option("compression", "zstd").parquet(at)
        return spark.read.schema(base.schema).parquet(at)

    def known() -> DataFrame:
        return spark.read.schema(base.schema).parquet(f"{path}/round-*")

    number = 0
    frontier = put(base.dropDuplicates(by) if distinct else base, number)
    while not frontier.isEmpty():
        number += 1
        if most_rounds is not None and number > most_rounds:
            raise RecursionError(f"no fixed point after {most_rounds} rounds")
        found = step(frontier)
        if distinct:
            found = found.select(*names).dropDuplicates(by).alias("found")
            seen = known().select(*by).alias("seen")
            found = found.join(seen, reduce(lambda x, y: x & y, [F.col(f"found.`{c}`").eqNullSafe(F.col(f"seen.`{c}`")) for c in by]), "left_anti")
        frontier = put(found, number)
    return known()


def _heads(links: DataFrame) -> DataFrame:
    """Of links (node, up), one for each node: (node, head), the first node above that has no link itself.

    Pointers double their length each round, so a chain takes the logarithm of its length in rounds. Nodes that lead
    into a circle have no head and are left out.
    """
    at = links
    n = at.count()
    for _ in range(ceil(log2(n)) + 1 if n > 1 else n):
        over = at.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        at = written(at.join(over, "up", "left").select("node", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_open")), "pointers")
        if at.filter("_open").isEmpty():
            break
        at = at.drop("_open")
    inner = at.select(F.col("node").alias("up"))
    return at.select("node", "up").join(inner, "up", "left_anti").select("node", F.col("up").alias("head"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that seeds (node) reach over edges (parent, child): (node), the seeds themselves left out.

    First the graph is contracted while it can be: a node with one parent is reached exactly if its parent is, so it
    hangs on the first node above it that is a seed, has no parent or has several, found by doubling pointers. Edges
    then lead from heads to nodes with several parents; where these fall together, a next contraction takes their child
    too. What hangs on no seed and has no parent goes. The rounds are the logarithm of the length of chains, times the
    contractions, of which nested ones (series of parallel paths) take one more for each level; only nodes that keep
    several parents are searched level by level, by fixpoint(). Circles, loops, repeated edges and nulls do no harm.
    """
    edges = edges.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL AND parent != child")
    seeds = written(seeds.select("node").filter("node IS NOT NULL").distinct(), "seeds")
    edges = written(edges.join(seeds.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child").distinct(), "edges")
    hanging: list[DataFrame] = []
    while True:
        one = edges.groupBy("child").agg(F.count(F.lit(1)).alias("_n"), F.min("parent").alias("up"))
        single = written(one.filter("_n = 1").select(F.col("child").alias("node"), "up"), "single")
        if single.isEmpty():
            break
        heads = written(_heads(single), "heads")
        hanging.append(heads)
        # parents that lead into a circle have no head; heads without a parent that are no seeds are reached by nothing
        alive = edges.select(F.col("child").alias("parent")).union(seeds.select("node")).distinct()
        rest = edges.join(single.select(F.col("node").alias("child")), "child", "left_anti")
        moved = rest.join(heads.select(F.col("node").alias("parent"), "head"), "parent", "left").join(single.select(F.col("node").alias("parent"), F.lit(True).alias("_single")), "parent", "left")
        moved = moved.filter(F.col("head").isNotNull() | F.col("_single").isNull()).select(F.coalesce("head", "parent").alias("parent"), "child")
        moved = moved.join(alive, "parent", "left_semi").filter("parent != child").distinct()
        edges = written(moved.select("parent", "child"), "edges")
    over = edges.select(F.col("parent").alias("node"), "child")
    found = seeds if edges.isEmpty() else fixpoint(seeds, lambda last: last.join(over, "node").select(F.col("child").alias("node")))
    for heads in reversed(hanging):
        # a head may hang on another one by a later contraction, which is resolved by now
        more = heads.join(found.select(F.col("node").alias("head")), "head", "left_semi").select("node")
        found = written(found.union(more).distinct(), "reached")
    return found.join(seeds, "node", "left_anti")
