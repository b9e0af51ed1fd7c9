"""Operator 4, token counts from an exact length histogram.

Documents are aggregated by their encoded length. The histogram has one row for each length that
occurs, however many documents there are, and suffix sums over it answer for every context limit how
many documents reach it, how many tokens there are, and how many stay when longer ones are truncated.
The sums run within blocks of lengths and over the blocks' totals, so no task sees all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import TEXT, encoder
from tesserae.llm.common import rounds, text_of, tidy
from tesserae.session import written

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The number of ids of each whole text, without special tokens: (n_tokens). A null text has none."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for _, texts in (part for whole in batches for part in rounds(whole, 0, TEXT)):
            yield pa.RecordBatch.from_arrays([pa.array(enc.batch(texts)[1])], ["n_tokens"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """Documents by length: (n_tokens, n_docs)."""
    return lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, as a context limit:

    n_docs of that length, docs_from (that long or longer), docs_within (that long or shorter),
    tokens_within (in those), tokens_from (in documents that long or longer), tokens_truncated (of all
    documents, each cut at the limit) and share_within (docs_within / all documents: the quantile that
    this length is). Between two lengths that occur, truncated totals are linear: the shorter length's
    plus docs_from of the longer one for each token of the limit. An empty histogram gives no rows.
    """
    rows = histogram.withColumn("_b", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    whole = Window.partitionBy()
    blocks = blocks.select(
        "_b",
        F.coalesce(F.sum("_d").over(below), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_docs"),
        F.sum("_t").over(whole).alias("_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"_d1": F.sum("n_docs").over(inside), "_t1": F.sum(tokens).over(inside)}).join(blocks, "_b")
    within, t_within = F.col("_d0") + F.col("_d1"), F.col("_t0") + F.col("_t1")
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("_docs") - within + F.col("n_docs")).alias("docs_from"),
        within.alias("docs_within"),
        t_within.alias("tokens_within"),
        (F.col("_tokens") - t_within + tokens).alias("tokens_from"),
        (t_within + F.col("n_tokens") * (F.col("_docs") - within)).alias("tokens_truncated"),
        (within / F.col("_docs")).alias("share_within"),
    )


def op4(docs: DataFrame, path: str) -> DataFrame:
    """One row per encoded length of documents, as `limits` says."""
    return limits(written(length_histogram(encoded_lengths(docs, path)), "histogram"))
