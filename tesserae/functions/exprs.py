"""Projections and predicates as small reusable pieces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Project and rename; source names may hold dots."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in names.items()])


def full_match(col: Column, pattern: str) -> Column:
    """Whether the whole text matches; unlike `$`, the end is not before a final newline."""
    return col.rlike(rf"\A(?:{pattern})\z")


def stamp(df: DataFrame, as_of: str | None, col: str = "as_of") -> DataFrame:
    """A constant date on every row; an empty one is null."""
    return df.withColumn(col, F.lit(as_of or None).cast("date"))


def type_identifier(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], drop_other: bool = True, into: str = "key_type") -> DataFrame:
    """The scheme of an identifier: the name of the first rule (regex for the whole value, name) that matches."""
    kind = F.coalesce(*[F.when(full_match(F.col(col), pattern), F.lit(name)) for pattern, name in rules], F.lit("other"))
    out = df.withColumn(into, kind)
    return out.filter(F.col(into) != "other") if drop_other else out


def contains_text(corpus: Column, needle: str) -> Column:
    """Substring search in a corpus column that is lower-case already."""
    return F.contains(corpus, F.lit(needle.lower()))


def position_in(col: Column, order: Sequence[str]) -> Column:
    """Place of a value in a fixed list, null where it is not in it."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), col), F.lit(0).cast("bigint"))
