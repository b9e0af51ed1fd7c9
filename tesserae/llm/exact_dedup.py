"""Operator 1, exact de-duplication by progressive refinement, with DataFrame operations alone.

Rows are grouped by length, the groups of two or more by a hash of a prefix, and only the rows whose
(length, prefix hash) is shared have their whole text hashed. Groups are tables of keys and counts
made with map-side sums, and the joins against them meet Spark's skew handling, as each side has an
exchange of its own; a text is shuffled by document id, never by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WHITE, id_back, id_of, row_hash, text_of
from tesserae.session import written

#: Code points of the normalised text that the second refinement hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two or more rows have, as a written table, so that a join with it gets an exchange of its own."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "shared")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Groups of rows whose normalised texts are equal: (id, row_hash, keep_id, group_size, kept).

    Of a group, the row with the most code points in its original text stays, then the smallest id.
    One row comes back for each distinct (id, text); rows that repeat an id with the same text share
    it, and count each in group_size. A null text is empty, and empty texts are equal. A null id is
    after all others. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(id_of(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_row", row_hash("_text")).withColumn("_norm", normalised(F.col("_text")))
    slim = written(
        rows.select("_id", "_row", F.length("_text").alias("_chars"), F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_pre")),
        "slim",
    )
    same_len = slim.join(_shared(slim, ["_len"]), ["_len"], "left_semi")
    survivors = same_len.join(_shared(same_len, ["_len", "_pre"]), ["_len", "_pre"], "left_semi").select("_id", "_row").distinct()
    full = written(
        rows.join(survivors, ["_id", "_row"], "left_semi").select("_id", "_row", F.length("_text").alias("_chars"), F.sha2("_norm", 256).alias("_sha")), "full"
    )
    groups = written(
        full.groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct((-F.col("_chars")).alias("_fewer"), "_id")).alias("_best")).filter("_size > 1"), "groups"
    )
    grouped = full.join(groups, "_sha").select("_id", "_row", "_chars", "_size", F.col("_best._id").alias("_keep"), (-F.col("_best._fewer")).alias("_most")).distinct()
    out = slim.select("_id", "_row").distinct().join(grouped, ["_id", "_row"], "left")
    keep = F.coalesce("_keep", "_id")
    return out.select(
        id_back("_id").alias("id"),
        F.col("_row").alias("row_hash"),
        id_back(keep).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("_keep") == F.col("_id")) & (F.col("_chars") == F.col("_most")), F.lit(True)).alias("kept"),
    )


def op1(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    out = exact_dedup(docs)
    rows = docs.select("doc_id", row_hash("text").alias("_row"), F.sha2(normalised(text_of("text")), 256).alias("text_sha256"))
    joined = rows.join(out, rows["doc_id"].eqNullSafe(out["id"]) & (rows["_row"] == out["row_hash"]))
    return joined.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
