"""Tiered identity crosswalks: admission of identifiers, typed edges, precedence, enrichment, the closing gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import mod97, search_corpus
from tesserae.operators.reshape import first_values, union_by_name
from tesserae.operators.windows import best_per_key

EDGE = ["key_type", "key", "lei", "category", "method", "tier", "confidence"]


def admit(df: DataFrame, col: str, register: DataFrame, register_col: str) -> DataFrame:
    """Rows whose identifier has remainder 1, or that the register publishes; all others go, null ones too."""
    known = register.select(F.col(register_col).alias("_known")).filter(F.col("_known").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    joined = df.withColumn("_id", F.upper(F.trim(col))).join(known, F.col("_id") == F.col("_known"), "left")
    return joined.filter(F.coalesce(mod97(F.col(col)) == 1, F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_id", "_known", "_hit")


def typed_edges(df: DataFrame, key: Column, lei: Column, key_type: Column | str, method: str, tier: str = "authoritative", confidence: float = 1.0, category: Column | str | None = None) -> DataFrame:
    """Edges of one source in the common shape; texts for key_type and category are constants."""
    const = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return df.select(
        const(key_type).alias("key_type"),
        key.cast("string").alias("key"),
        F.upper(F.trim(lei)).alias("lei"),
        const(category).alias("category"),
        F.lit(method).alias("method"),
        F.lit(tier).alias("tier"),
        F.lit(float(confidence)).alias("confidence"),
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (key_type, key, lei): the most confident, then by method and category."""
    order = [F.col("confidence").desc_nulls_last(), F.col("method").asc_nulls_last(), F.col("category").asc_nulls_last(), F.col("tier").asc_nulls_last()]
    return best_per_key(edges, ["key_type", "key", "lei"], order)


def build_edges(sources: Sequence[DataFrame], resolved: DataFrame, resolved_type: str = "cik") -> DataFrame:
    """Authoritative edges of all sources, and probabilistic ones for keys that none of them has.

    resolved has key, lei, method, status, match_probability; its status becomes the tier.
    """
    sure = dedup_edges(union_by_name(*sources).select(*EDGE))
    maybe = resolved.select(
        F.lit(resolved_type).alias("key_type"),
        F.col("key").cast("string").alias("key"),
        F.upper("lei").alias("lei"),
        F.lit(None).cast("string").alias("category"),
        "method",
        F.col("status").alias("tier"),
        F.col("match_probability").alias("confidence"),
    ).filter(F.col("tier").isin("confirmed", "candidate", "ambiguous"))
    taken = sure.select("key_type", "key").distinct()
    return sure.unionByName(dedup_edges(maybe.join(taken, ["key_type", "key"], "left_anti")))


def enrich_edges(edges: DataFrame, register: DataFrame, names: DataFrame, name_type: str = "cik", default_category: str = "GENERAL", as_of: str | None = None) -> DataFrame:
    """Edges with names, ticker list, register columns, snapshot date and search corpus; their number stays.

    register: lei, legal_name, jurisdiction, reg_status (one row for each lei). names: key, company_name,
    ticker, several rows for a key; it is aggregated before the join, and meets edges of name_type alone.
    """
    tickers = F.array_join(F.array_sort(F.collect_set("ticker")), ",")
    by_key = names.groupBy(F.col("key").alias("_key")).agg(F.nullif(tickers, F.lit("")).alias("ticker"), F.min("company_name").alias("_company"))
    out = edges.join(register, "lei", "left").join(by_key, (F.col("key_type") == name_type) & (F.col("key") == F.col("_key")), "left")
    company = F.coalesce("_company", "legal_name")
    return out.select(
        "key_type",
        "key",
        "ticker",
        company.alias("company_name"),
        "lei",
        "legal_name",
        F.coalesce("category", F.lit(default_category)).alias("category"),
        "jurisdiction",
        "reg_status",
        "method",
        "tier",
        F.round("confidence", 6).alias("confidence"),
        F.lit(as_of or None).cast("date").alias("as_of"),
        search_corpus(company, F.col("legal_name"), F.col("ticker"), F.col("lei")).alias("corpus"),
    )


def entity_universe(lines: DataFrame, tickers: DataFrame, col: str = "value") -> DataFrame:
    """Entities from `name:0000000000:` lines with their ticker: (cik, company_name, ticker).

    Malformed lines, and lines without a name, go. tickers: cik, ticker; several to a cik give the least.
    """
    parsed = split_trailing_token(lines, col, r":(\d+):")
    by = tickers.groupBy("cik").agg(F.min("ticker").alias("ticker"))
    return parsed.select(F.col("token").try_cast("bigint").cast("string").alias("cik"), F.col("name").alias("company_name")).join(by, "cik", "left")


def split_trailing_token(df: DataFrame, col: str, pattern: str, name: str = "name", token: str = "token") -> DataFrame:
    """Lines that end in a token (group 1 of the pattern), split into the text before it and the token."""
    whole = rf"\A([\s\S]+?){pattern}\z"
    out = df.filter(F.col(col).rlike(whole))
    return out.withColumns({name: F.trim(F.regexp_extract(col, whole, 1)), token: F.regexp_extract(col, whole, 2)}).filter(F.col(name) != "")


def unadmitted(edges: DataFrame, register: DataFrame) -> DataFrame:
    """The closing gate's findings: edges whose lei neither has remainder 1 nor is published: (edges, distinct_leis, examples); no rows if there are none."""
    known = register.select("lei").distinct()
    bad = edges.filter(F.coalesce(mod97(F.col("lei")) != 1, F.lit(True))).join(known, "lei", "left_anti")
    counts = bad.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("lei").alias("distinct_leis")).filter("edges > 0")
    return counts.crossJoin(F.broadcast(first_values(bad, [], "lei")))  # one row each
