"""Quality gates: each returns findings as a small table, enforce() turns findings into an error."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.joins import fk_orphans


class GateError(ValueError):
    """A gate has findings."""


def enforce(findings: DataFrame, gate: str, most: int = 5) -> None:
    """Raise with up to `most` findings; nothing happens where there are none."""
    rows = findings.take(most + 1)
    if rows:
        listed = "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows[:most])
        raise GateError(f"{gate}: {listed}" + (" …" if len(rows) > most else ""))


def row_count_delta(actual: DataFrame, baseline: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Tables (name, n) whose count is off the baseline (name, expected) by more than the tolerance; unlisted ones pass."""
    joined = baseline.join(actual, "name")
    low, high = F.col("expected") * (1 - tolerance), F.col("expected") * (1 + tolerance)
    return joined.filter((F.col("n") < low) | (F.col("n") > high)).select("name", "expected", "n")


def referential(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Number of non-null keys of child that parent lacks: (orphans), no row for none."""
    return fk_orphans(child, parent, child_key, parent_key).agg(F.count(F.lit(1)).alias("orphans")).filter("orphans > 0")


def golden_missing(df: DataFrame, golden: DataFrame) -> DataFrame:
    """Golden rows that df does not hold exactly; null equals null."""
    cols = golden.columns
    have = df.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    return golden.join(have, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]), "left_anti")


def count_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b) where two tables differ in their number of rows."""
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(a, "n_a").crossJoin(n(b, "n_b")).filter("n_a != n_b")  # one row each


def java_pattern(pattern: str) -> str:
    """A contract's pattern for Spark: an unescaped `$` outside a class is the end of the text alone, not of a last line."""
    out, k, within = "", 0, False
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "\\":
            out, k = out + pattern[k - 1 : k + 1], k + 1
        elif within:
            within = c != "]"
            out += "\\" + c if c in "[&" else c  # these two mean more in a class of Spark's patterns
        elif c == "[":
            within = True
            if pattern[k : k + 1] == "^":
                c, k = "[^", k + 1
            if pattern[k : k + 1] == "]":  # first in a class it stands for itself
                c, k = c + "\\]", k + 1
            out += c
        else:
            out += r"\z" if c == "$" else c
    return out


def _as_text(value: object) -> str:
    """A JSON value as a column's text has it: true and false, numbers as they are, texts without quotes."""
    return value if isinstance(value, str) else json.dumps(value)


def _rejects(col: Column, rule: Mapping) -> list[tuple[Column, str]]:
    """Conditions on a value as text that a column rule refuses, with their messages; keywords without force are left out."""
    out = []
    if "enum" in rule:
        out.append((~col.isin([_as_text(v) for v in rule["enum"]]), "not in the list"))
    if "const" in rule:
        out.append((col != _as_text(rule["const"]), "not the constant"))
    if "pattern" in rule:
        out.append((~col.rlike(java_pattern(rule["pattern"])), "does not match"))
    if "minLength" in rule:
        out.append((F.length(col) < rule["minLength"], "too short"))
    if "maxLength" in rule:
        out.append((F.length(col) > rule["maxLength"], "too long"))
    return out


def validate_contract(df: DataFrame, contract: Mapping) -> DataFrame:
    """One pass over df against a JSON-Schema column contract: (column_name, total, rejects, sample_message).

    Values are compared as text. enum, const, pattern, minLength and maxLength count; numeric ranges do
    not. Nulls are invisible: neither counted nor refused. Nested columns are reported as skipped. Only
    columns that the contract and df share are checked. Most rejects first, then by name.
    """
    aggs, names = [], []
    for name, rule in contract["properties"].items():
        if name not in df.columns:
            continue
        names.append(name)
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.col(f"`{name}`").cast("string")
        bad = [] if nested else _rejects(text, rule)
        refused = reduce(lambda a, b: a | b, [c for c, _ in bad], F.lit(False))
        refused = F.coalesce(refused, F.lit(False)) & (F.lit(False) if nested else text.isNotNull())
        message = F.coalesce(*[F.when(c, F.concat(text, F.lit(f": {m}"))) for c, m in bad], F.lit(None).cast("string"))
        k = len(names) - 1
        aggs += [
            (F.lit(0).cast("long") if nested else F.count(text)).alias(f"t{k}") if not nested else F.sum(F.lit(0)).alias(f"t{k}"),
            F.count_if(refused).alias(f"r{k}"),
            F.min(F.when(refused, message)).alias(f"m{k}") if not nested else F.max(F.lit("skipped: nested")).alias(f"m{k}"),
        ]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, total long, rejects long, sample_message string")
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.coalesce(F.col(f"t{k}"), F.lit(0)).cast("long").alias("total"), F.col(f"r{k}").alias("rejects"), F.col(f"m{k}").alias("sample_message")) for k, n in enumerate(names)])
    return one.select(F.inline(rows)).orderBy(F.col("rejects").desc(), "column_name")


def derive_contract(df: DataFrame, max_enum: int = 20) -> dict:
    """A contract that every current row passes: the values of columns with few, lengths for the others."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    text = {c: F.col(f"`{c}`").cast("string") for c in flat}
    aggs = [a for k, c in enumerate(flat) for a in (F.approx_count_distinct(text[c]).alias(f"d{k}"), F.min(F.length(text[c])).alias(f"lo{k}"), F.max(F.length(text[c])).alias(f"hi{k}"))]
    row = df.agg(*aggs).first()
    few = [(k, c) for k, c in enumerate(flat) if row[f"d{k}"] <= 2 * max_enum]
    sets = {}
    for k, c in few:
        found = [r[0] for r in df.select(text[c]).filter(text[c].isNotNull()).distinct().limit(max_enum + 1).collect()]
        if len(found) <= max_enum:
            sets[c] = sorted(found)
    props = {}
    for k, c in enumerate(flat):
        if c in sets:
            props[c] = {"type": "string", "enum": sets[c]}
        elif row[f"lo{k}"] is not None:
            props[c] = {"type": "string", "minLength": row[f"lo{k}"], "maxLength": row[f"hi{k}"]}
        else:
            props[c] = {"type": "string"}
    return json.loads(json.dumps({"type": "object", "properties": props}))


def licence_status(df: DataFrame, licence: str, redistribution: str, cleared: Sequence[str], flags: Sequence[str], into: str = "licence_status") -> DataFrame:
    """green where both the licence and its redistribution flag are on the lists, else red; missing is red."""
    ok = F.coalesce(F.col(licence).isin(list(cleared)) & F.col(redistribution).isin(list(flags)), F.lit(False))
    return df.withColumn(into, F.when(ok, "green").otherwise("red"))


def completeness(df: DataFrame, advertised: int, page: int) -> DataFrame:
    """(received, advertised) where more than one page is missing."""
    return df.agg(F.count(F.lit(1)).alias("received")).withColumn("advertised", F.lit(advertised)).filter(F.col("received") < advertised - page)


def case_collisions(df: DataFrame, name: str, producer: str) -> DataFrame:
    """Names that differ in case alone: (name, spellings), unless exactly one spelling has a producer."""
    spelled = df.groupBy(F.lower(name).alias("name"), F.col(name).alias("_s")).agg(F.max(F.col(producer).cast("int")).alias("_p"))
    by = spelled.groupBy("name").agg(F.count(F.lit(1)).alias("spellings"), F.sum("_p").alias("_made"))
    return by.filter((F.col("spellings") > 1) & (F.coalesce("_made", F.lit(0)) != 1)).select("name", "spellings")


def check_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise where a declared key names a column that df lacks."""
    if missing := [k for k in keys if k not in df.columns]:
        raise GateError(f"no such columns: {', '.join(missing)}; present: {', '.join(df.columns)}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have: the key and n_rows."""
    check_keys(df, keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
