"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import language_id, line_dedup, ngram_join, packing, secrets
from tesserae.llm.common import LAST_ID, id_of, whole_row
from tesserae.llm.queries import tokenizer_path
from tesserae.session import ship, table, written

#: Texts whose best decision value (1: like the language's own texts, 0: like all others') is smaller are of no known
#: language, however many languages there are: the second limit for texts of SHORT characters or more, whose values vary less.
MIN_VALUES, SHORT = (0.25, 0.45), 200
#: Near duplicates: words in a shingle, and the percentage of similarity.
WORDS, PERCENT = 5, 80

#: Language, tokens and bin packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose best decision value is under the limit for their length, go. A null text has no letters.

    Where no document has a language to learn from, none is known and all go.
    """
    ship(spark)
    model = language_id.fit(docs)
    marked = docs.select(whole_row(docs), language_id.predict(docs, model).alias("_p"))
    least = F.when(F.length("doc.text") < SHORT, MIN_VALUES[0]).otherwise(MIN_VALUES[1])
    return marked.filter((F.col("_p.lang") != language_id.UNKNOWN) & (F.col("_p.value") >= least)).select("doc.*")


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go, and documents of which nothing is left."""
    ship(spark)
    return _counted(line_dedup.line_dedup(docs))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows of one id stay together.

    A row without an id is a document of its own, after all that have one, in the order in which the rows are written;
    ids are below 2**62.
    """
    ship(spark)
    nameless = F.col("doc_id").isNull()
    rows = docs.select(whole_row(docs), id_of("doc_id").alias("_id"), "text")
    if not docs.filter(nameless).isEmpty():
        # written, so that a row has its number in every job that reads it
        own = F.when(nameless, F.lit(LAST_ID - (1 << 61)) + F.monotonically_increasing_id()).otherwise(id_of("doc_id"))
        rows = written(docs.select(whole_row(docs), own.alias("_id"), "text"), "numbered")
    found = ngram_join.ngram_components(rows.select("_id", "text"), WORDS, PERCENT, id_col="_id")
    stays = found.filter(F.col("component_id").eqNullSafe(F.col("id"))).select(id_of("id").alias("_id")).distinct()
    return rows.select("doc", "_id").join(stays, "_id", "left_semi").select("doc.*")


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    ship(spark)
    return _counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece and its place in a sequence."""
    ship(spark)
    return packing.op6(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_join", no_near_copies),
    ("secret_scan", no_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
