"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.bpe import op9
from tesserae.llm.collocations import OP13_SQL, op13
from tesserae.llm.exact_dedup import OP1_SQL, op1
from tesserae.llm.fingerprints import op3
from tesserae.llm.language_id import op10
from tesserae.llm.line_dedup import OP8_SQL, op8
from tesserae.llm.ngram_join import op2
from tesserae.llm.packing import op6
from tesserae.llm.periodic import op12
from tesserae.llm.secrets import op5
from tesserae.llm.substring_dedup import OP11_SQL, op11
from tesserae.llm.token_counts import op4
from tesserae.llm.warc import OP7_SQL, op7
from tesserae.session import is_local, ship, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The driver's path of a tokenizer file; on a cluster the file goes to the executors too, which open_file finds there."""
    import public_tokenizers

    path = public_tokenizers.path(name)
    if (spark := SparkSession.getActiveSession()) and not is_local(spark):
        spark.sparkContext.addFile(path)
    return path


def _over(name: str, f: Callable[..., DataFrame], tokenizer: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(table(spark, sf_dir, name), *[tokenizer_path()] * tokenizer)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": _over("documents", op1),
        "op2_ngram_join": _over("documents", op2),
        "op3_spot_fingerprints": _over("documents", op3),
        "op4_token_counts": _over("documents", op4, tokenizer=True),
        "op5_secret_scan": _over("documents", op5),
        "op6_best_fit_packing": _over("documents", op6, tokenizer=True),
        "op7_warc": _over("pages", op7),
        "op8_line_dedup": _over("documents", op8),
        "op10_language_id": _over("documents", op10),
        "op9_bpe": _over("documents", op9, tokenizer=True),
        "op11_substring_dedup": _over("documents", op11),
        "op12_periodic_runs": _over("documents", op12),
        "op13_collocations": _over("documents", op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op7_warc": OP7_SQL,
        "op8_line_dedup": OP8_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op13_collocations": OP13_SQL,
    }
