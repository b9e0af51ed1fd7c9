"""Lineage over tables: reads before their producer, downstream closure, run history, redaction."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.fixpoint import reachable

# Parts of key names that look like secrets, and what replaces their values.
SECRET_KEYS = "secret token password passwd credential api_key apikey access_key auth".split()
REDACTED = "***REDACTED***"


def read_before_produce(steps: DataFrame) -> DataFrame:
    """(step, asset, producer_no) where a step reads what only a later step produces first.

    steps: step_no, step, reads, produces. What the step itself produces, or nobody, is exempt.
    """
    made = steps.select(F.explode("produces").alias("asset"), "step_no", "step")
    first = made.groupBy("asset").agg(F.min("step_no").alias("producer_no"))
    reads = steps.select("step_no", "step", F.explode("reads").alias("asset")).distinct()
    late = reads.join(first, "asset").filter(F.col("producer_no") > F.col("step_no"))
    return late.join(made.select("asset", "step").distinct(), ["asset", "step"], "left_anti").select("step", "asset", "producer_no")


def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that seeds (node) reach over edges (parent, child), seeds themselves left out; see fixpoint.reachable."""
    return reachable(edges, seeds)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_COLON = re.compile(r"\s*:\s*")


def redacted_text(text: str, needles: Sequence[str] = SECRET_KEYS) -> str | None:
    """JSON text with every value under a secret-looking key replaced, whatever the value is and however deep; None for text that is no JSON.

    The rest of the text stays as it is written. Keys are compared as they read, escapes resolved.
    """
    try:
        json.loads(text)
        out, at, copied = [], 0, 0
        while m := _STRING.search(text, at):
            at = m.end()
            if (colon := _COLON.match(text, at)) is None:
                continue
            at = colon.end()
            key = json.loads(m[0]).lower()
            if any(n in key for n in needles):
                out += [text[copied:at], f'"{REDACTED}"']
                at = copied = json.JSONDecoder().raw_decode(text, at)[1]
        return "".join([*out, text[copied:]])
    except (ValueError, RecursionError):
        return None


def redact_json(col: Column) -> Column:
    """redacted_text of a column, in Arrow batches: null where the text is null or no JSON, so that nothing unread gets through."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else redacted_text(t) for x in text), pa.string())

    return run(col)


STEPS = "step string, state string, attempts int, started timestamp, ended timestamp, skip_reason string, consumed array<string>, produced array<string>"


def run_history(contracts: DataFrame, steps: str = "steps") -> DataFrame:
    """Steps of run contracts: a row for each run and step, with `seconds` from started to ended where both are there.

    contracts: run_id, and an array of structs that have `step` and any other fields of STEPS; fields
    that are absent are null. A run without steps gives no rows.
    """
    rows = contracts.select("run_id", F.explode(steps).alias("_s"))
    has = rows.schema["_s"].dataType.fieldNames()
    wanted = [f.split() for f in STEPS.split(", ")]
    out = rows.select("run_id", *[(F.col(f"_s.{n}") if n in has else F.lit(None)).cast(t).alias(n) for n, t in wanted])
    return out.withColumn("seconds", F.col("ended").cast("double") - F.col("started").cast("double"))


def run_edges(history: DataFrame) -> DataFrame:
    """(run_id, step, asset, direction) of what each step of a history consumed and produced, once each; skipped steps count for nothing."""
    ran = history.filter(F.col("skip_reason").isNull())
    one = lambda c: ran.select("run_id", "step", F.explode(c).alias("asset"), F.lit(c).alias("direction"))
    return one("consumed").unionAll(one("produced")).distinct()
