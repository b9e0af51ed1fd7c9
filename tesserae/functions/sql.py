"""The SQL surface: the library's scalars as functions that spark.sql knows, and session variables."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Mapping

from pyspark.sql import SparkSession

from tesserae.functions.scalars import accent_map

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FROM, _TO = accent_map()

#: Name: (parameters, result, expression over the parameters). Each gives what the Column function of that name gives.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strip_accents": ("s STRING", "STRING", f"regexp_replace(translate(s, '{_FROM}', '{_TO}'), '\\\\p{{Mn}}', '')"),
    "unpad": ("s STRING", "STRING", "CAST(try_cast(s AS BIGINT) AS STRING)"),
    "mod97": (
        "s STRING",
        "INT",
        f"CASE WHEN regexp_like(upper(trim(s)), '\\\\A[0-9A-Z]+\\\\z') THEN reduce(transform(split(upper(trim(s)), ''), c -> instr('{_DIGITS}', c) - 1), 0, (acc, v) -> (acc * CASE WHEN v >= 10 THEN 100 ELSE 10 END + v) % 97) END",
    ),
    "clean_text": ("s STRING", "STRING", "nullif(nullif(trim(regexp_replace(s, '\\\\s+', ' ')), ''), 'null')"),
    "thousands": ("s STRING", "INT", "try_cast(replace(s, ',', '') AS INT)"),
    "iso_date": ("s STRING", "DATE", "try_cast(substring(s, 1, 10) AS DATE)"),
    "json_at": ("j STRING, place INT", "STRING", "get_json_object(j, concat('$[', place, ']'))"),
    "ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
    "scaled": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "coalesce(try_divide(v - low, high - low), 0D)"),
    "valid_digest": ("s STRING", "BOOLEAN", "coalesce(regexp_like(s, '\\\\A[0-9a-f]{64}\\\\z'), FALSE)"),
}


def define_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make FUNCTIONS temporary functions of the session, in place of any of those names, and return their names.

    They are expressions that Catalyst inlines, so they cost what the Column functions cost.
    """
    names = []
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(prefix + name)
    return names


def literal(value: object) -> str:
    """A Python value as a SQL literal."""
    match value:
        case None:
            return "NULL"
        case bool():
            return str(value).upper()
        case datetime.datetime():
            return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
        case datetime.date():
            return f"DATE '{value.isoformat()}'"
        case int():
            return str(value)
        case float():
            return f"CAST('{value}' AS DOUBLE)"
        case decimal.Decimal():
            return f"{value}BD"
        case str():
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def set_variables(spark: SparkSession, values: Mapping[str, object]) -> None:
    """Session variables that SQL texts read by name, in place of any of those names; an empty text is null, as an unset one is."""
    for name, value in values.items():
        if not name.isidentifier():
            raise ValueError(f"not a name: {name}")
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} DEFAULT {literal(None if value == '' else value)}")
