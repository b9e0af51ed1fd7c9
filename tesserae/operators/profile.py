"""Column profiles, semantic types by rules, and dataset descriptors."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.fingerprint import dataset_fingerprint
from tesserae.operators.gates import check_keys
from tesserae.operators.windows import seeded_sample
from tesserae.session import written
from tesserae.sources.readers import file_manifest

# Fixed patterns of semantic types, first match wins; a date needs separators, so eight digits are an integer.
SEMANTIC = [
    ("boolean", r"(?i)true|false"),
    ("integer", r"[+-]?\d+"),
    ("decimal", r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("date", r"\d{4}-\d{2}-\d{2}"),
    ("uuid", r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    ("email", r"[^@\s]+@[^@\s]+\.[^@\s]+"),
    ("url", r"https?://\S+"),
    ("country_code", r"[A-Z]{2}"),
]
ENGINE = "pyspark"


def _flat(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def profile(df: DataFrame, sample_size: int | None = None, key: str | None = None) -> DataFrame:
    """A row for each flat column, from one pass: type, n, nulls, approximate distinct, least and largest value and length."""
    rows = seeded_sample(df, sample_size, key or df.columns[0]) if sample_size else df
    cols = _flat(df)
    aggs = []
    for k, c in enumerate(cols):
        x = F.col(f"`{c}`")
        t = x.cast("string")
        aggs += [F.count(x).alias(f"n{k}"), F.approx_count_distinct(x).alias(f"d{k}"), F.min(x).cast("string").alias(f"a{k}"), F.max(x).cast("string").alias(f"b{k}"), F.min(F.length(t)).alias(f"p{k}"), F.max(F.length(t)).alias(f"q{k}")]
    one = rows.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.col(f"n{k}").alias("n_values"),
            (F.col("_rows") - F.col(f"n{k}")).alias("n_nulls"),
            F.col(f"d{k}").alias("approx_distinct"),
            F.col(f"a{k}").alias("least"),
            F.col(f"b{k}").alias("largest"),
            F.col(f"p{k}").alias("shortest"),
            F.col(f"q{k}").alias("longest"),
        )
        for k, c in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*structs)))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column, ties by value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.col("n_rows").desc(), F.col("value").asc_nulls_last()).limit(n)


#: Values that a frequency sketch follows for each column, and the accuracy of quantiles (one over the share of ranks they may be off).
FOLLOWED, ACCURACY = 10_000, 10_000


def sketch(df: DataFrame, top: int = 10, quantiles: Sequence[float] = (0.25, 0.5, 0.75), followed: int = FOLLOWED, accuracy: int = ACCURACY, max_enum: int = 20, exact: bool = False) -> DataFrame:
    """Frequent values, quantiles and observed constraints of all flat columns from one pass of mergeable sketches.

    (column_name, n_values, frequent, frequent_error, quantiles, constraints). frequent: the `top` values as text with
    their counts, most first, then by value; a count is off by frequent_error at most, which is 0 where the column has
    no more values than the sketch follows, and every value of a greater true count than the last one's and the error
    is listed. quantiles: of numbers alone, values whose rank is off by about n / accuracy; with exact, the sketch only
    says where to look, and exact_quantiles finds the values themselves in two more passes of each such column, at
    once. constraints: what all
    rows satisfy: required, minimum and maximum of numbers, minLength and maxLength of texts, and enum, the sorted
    values, where there are max_enum at most. Tasks send sketches of a fixed size for each column; no column is
    shuffled. Nulls count nowhere; a column without values has neither frequent values nor bounds.
    """
    cols = _flat(df)
    asked = _around(quantiles, accuracy) if exact else list(quantiles)
    n_top = max(top, max_enum + 1)
    aggs, structs = [F.count(F.lit(1)).alias("_rows")], []
    size = 1 << max(3, (int(followed / 0.75) - 1).bit_length())  # places of the sketch's table
    for k, c in enumerate(cols):
        x, kind = F.col(f"`{c}`"), df.schema[c].dataType
        number = isinstance(kind, T.NumericType)
        plain = F.expr(f"approx_top_k(CAST(`{c}` AS STRING), {n_top}, {followed}) FILTER (WHERE `{c}` IS NOT NULL)")
        aggs += [
            F.count(x).alias(f"n{k}"),
            plain.alias(f"t{k}"),
            F.approx_count_distinct(x).alias(f"d{k}"),
            (F.percentile_approx(x.cast("double"), asked, accuracy) if number else F.max(F.lit(None).cast("array<double>"))).alias(f"q{k}"),
            F.min(x if number else F.length(x.cast("string"))).cast("double").alias(f"a{k}"),
            F.max(x if number else F.length(x.cast("string"))).cast("double").alias(f"b{k}"),
        ]
        listed = F.coalesce(F.col(f"t{k}"), F.array().cast("array<struct<item:string,count:bigint>>"))
        ordered = F.array_sort(F.transform(listed, lambda s: F.struct((-s["count"]).alias("count"), s["item"].alias("value"))))
        frequent = F.transform(F.slice(ordered, 1, top), lambda s: F.struct(s["value"].alias("value"), (-s["count"]).alias("n_rows")))
        # the sketch drops values only when its table is fuller than three quarters; its counts are then off by 3.5 / size of n at most
        whole = (F.aggregate(listed, F.lit(0).cast("long"), lambda s, x: s + x["count"]) == F.col(f"n{k}")) | (F.col(f"d{k}") < F.lit(int(size * 0.6)))
        error = F.when(whole, F.lit(0)).otherwise(F.ceil(F.lit(3.5 / size) * F.col(f"n{k}"))).cast("long")
        few = whole & (F.size(listed) <= max_enum) & (F.size(listed) > 0)
        bound = lambda name, col, on: F.when(F.lit(on), F.col(col)).alias(name)
        constraints = F.struct(
            (F.col(f"n{k}") == F.col("_rows")).alias("required"),
            bound("minimum", f"a{k}", number),
            bound("maximum", f"b{k}", number),
            F.when(F.lit(not number), F.col(f"a{k}").cast("int")).alias("minLength"),
            F.when(F.lit(not number), F.col(f"b{k}").cast("int")).alias("maxLength"),
            F.when(few, F.array_sort(F.transform(listed, lambda s: s["item"]))).alias("enum"),
        )
        structs.append(
            F.struct(F.lit(c).alias("column_name"), F.col(f"n{k}").alias("n_values"), frequent.alias("frequent"), error.alias("frequent_error"), F.col(f"q{k}").alias("quantiles"), constraints.alias("constraints"))
        )
    one = df.agg(*aggs)
    if exact:
        one = written(one, "sketch")  # one row
        numbers = [k for k, c in enumerate(cols) if isinstance(df.schema[c].dataType, T.NumericType)]
        near = one.select(*[f"q{k}" for k in numbers]).first() if numbers else ()
        for k, bounds in zip(numbers, near):
            found = exact_quantiles(df, cols[k], quantiles, bounds=bounds)
            one = one.withColumn(f"q{k}", F.array(*map(F.lit, found)).cast("array<double>") if found else F.lit(None).cast("array<double>"))
    return one.select(F.inline(F.array(*structs)))


def _around(quantiles: Sequence[float], accuracy: int) -> list[float]:
    """A share below and one above each quantile, twice as far as a sketch of that accuracy is off."""
    return [min(max(q + side * 2 / accuracy, 0.0), 1.0) for q in quantiles for side in (-1, 1)]


def exact_quantiles(df: DataFrame, col: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = ACCURACY, bounds: Sequence[float] | None = None) -> list[float]:
    """For each quantile the least value of a column of numbers that at least that share of its values do not exceed; none of a column without values.

    A sketch gives a value below and one above each (or bounds, two for each, as it gave them). One pass counts the
    values up to these, so a bound on the wrong side is seen and dropped; another groups the values between them,
    about 4 / accuracy of all, by value, and the counts up to each tell which one it is. Neither a task nor the driver
    gets more of the column than that. Nulls count nowhere.
    """
    x = F.col(f"`{col}`")
    at, rows = x.cast("double"), df.filter(x.isNotNull())
    bounds = bounds or rows.agg(F.percentile_approx(at, _around(quantiles, accuracy), accuracy)).first()[0]
    if not bounds:
        return []
    sides = list(zip(bounds[::2], bounds[1::2]))
    n, *counts = rows.agg(F.count(F.lit(1)), *[f for low, high in sides for f in (F.count_if(at < low), F.count_if(at <= high))]).first()
    inside, needs = [], []
    for k, (q, (low, high)) in enumerate(zip(quantiles, sides)):
        rank = max(1, n - int(n - n * Fraction(str(q))))  # rounded up
        below, upto = counts[2 * k : 2 * k + 2]
        holds = F.lit(True)
        if below < rank:
            holds = holds & (at >= low)
        if upto >= rank:
            holds = holds & (at <= high)
        inside.append(F.when(holds, F.lit(k)))
        needs.append(rank - (below if below < rank else 0))
    values = rows.select(F.explode(F.array_compact(F.array(*inside))).alias("k"), x.alias("value")).groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("value"))
    need = F.element_at(F.array(*map(F.lit, needs)), F.col("k") + 1)
    found = values.withColumn("_upto", upto).filter((F.col("_upto") >= need) & (F.col("_upto") - F.col("n") < need)).select("k", F.col("value").cast("double").alias("value"))
    by = {r["k"]: r["value"] for r in found.collect()}  # one for each quantile
    return [by[k] for k in range(len(sides))]


def infer_semantic_types(df: DataFrame, threshold: float = 0.95, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The first rule that at least `threshold` of a column's values match, from one pass: (column_name, semantic_type, share)."""
    rules = rules or SEMANTIC
    cols = _flat(df)
    aggs = [F.avg(F.col(f"`{c}`").cast("string").rlike(rf"\A(?:{p})\z").cast("double")).alias(f"s{k}_{j}") for k, c in enumerate(cols) for j, (_, p) in enumerate(rules)]
    one = df.agg(*aggs)
    rows = []
    for k, c in enumerate(cols):
        hit = [(F.col(f"s{k}_{j}") >= threshold, name, F.col(f"s{k}_{j}")) for j, (name, _) in enumerate(rules)]
        kind = F.coalesce(*[F.when(ok, F.lit(name)) for ok, name, _ in hit], F.lit("text"))
        share = F.coalesce(*[F.when(ok, s) for ok, _, s in hit])
        rows.append(F.struct(F.lit(c).alias("column_name"), kind.alias("semantic_type"), share.alias("share")))
    return one.select(F.inline(F.array(*rows)))


def stored(df: DataFrame, path: str) -> dict:
    """Size and digest of the files below a path: (path, bytes, hash): a file's own digest, or a fingerprint over the names and digests of several."""
    files = file_manifest(df.sparkSession, path).filter(~F.col("name").rlike(r"\A[._]"))
    one = files.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("sha256").alias("sha256")).first()
    if not one["n"]:
        raise ValueError(f"no files below {path}")
    digest = one["sha256"] if one["n"] == 1 else dataset_fingerprint(files.select(F.col("name").alias("path"), "sha256")).first()["fingerprint"]
    return {"path": path.rstrip("/").rsplit("/", 1)[-1], "bytes": one["bytes"], "hash": f"sha256:{digest}"}


def describe(df: DataFrame, name: str, overrides: Mapping | None = None, path: str | None = None, observed: bool = False) -> str:
    """A dataset descriptor as JSON with sorted keys: inferred fields, curated overrides on top, the engine's stamp last.

    With observed, each field's constraints hold what all rows satisfy (sketch) besides `required`.

    Where the path of the stored table is given, the resource has its size and digest too.

    overrides: title, resource {…}, fields {column: {…}}, primaryKey [], foreignKeys []. Overrides of
    columns that df lacks warn; keys that name such columns raise.
    """
    overrides = dict(overrides or {})
    kinds = {r["column_name"]: r["semantic_type"] for r in infer_semantic_types(df).collect()}
    cards = {r["column_name"]: r for r in profile(df).collect()}
    seen = {r["column_name"]: {k: v for k, v in r["constraints"].asDict().items() if v is not None} for r in sketch(df).collect()} if observed else {}
    fields = []
    for f in df.schema.fields:
        entry = {"name": f.name, "type": f.dataType.simpleString()}
        if f.name in cards:
            entry |= {"semantic_type": kinds[f.name], "constraints": {"required": cards[f.name]["n_nulls"] == 0} | seen.get(f.name, {})}
        fields.append(entry | dict(overrides.get("fields", {}).get(f.name, {})))
    for stale in sorted(set(overrides.get("fields", {})) - set(df.columns)):
        warnings.warn(f"override of a column that is not there: {stale}", stacklevel=2)
    relations = list(overrides.get("primaryKey", [])) + [c for fk in overrides.get("foreignKeys", []) for c in fk["fields"]]
    check_keys(df, relations)
    schema = {"fields": fields} | {k: overrides[k] for k in ("primaryKey", "foreignKeys") if k in overrides}
    resource = {"name": name, "schema": schema} | (stored(df, path) if path else {}) | dict(overrides.get("resource", {}))
    package = {"name": name, "resources": [resource]} | ({"title": overrides["title"]} if "title" in overrides else {})
    return json.dumps(package | {"engine": ENGINE}, sort_keys=True, indent=2, default=str)
