"""Scalar functions that Spark has no single built-in for, as Column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed range: the letters whose accents strip_accents folds; others keep theirs unless they are combining marks.
_FIRST, _LAST = 0xA0, 0x24F


def accent_map() -> tuple[str, str]:
    """Letters of the range that decompose to one base letter and marks, and those base letters."""
    pairs = []
    for code in range(_FIRST, _LAST + 1):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code) and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(col: Column) -> Column:
    """Letters without their accents: é → e; ß, ł and ø stay."""
    return F.regexp_replace(F.translate(col, *accent_map()), r"\p{Mn}", "")


def search_corpus(*cols: Column) -> Column:
    """Lower-case text without accents of several columns, nulls left out, for substring search."""
    return F.lower(strip_accents(F.concat_ws(" ", *cols)))


def unpad(col: Column) -> Column:
    """An all-digit identifier without leading zeros; null where it is not a number."""
    return col.try_cast("bigint").cast("string")


def mod97(col: Column) -> Column:
    """ISO 7064 MOD 97-10 remainder of an identifier: digits and letters as base-36 values, folded from the left.

    Null for null, empty or any character outside [0-9A-Z] after upper-casing and trimming, so that a
    test for 1 fails closed.
    """
    chars = F.split(F.upper(F.trim(col)), "")
    step = lambda acc, v: (acc * F.when(v >= 10, 100).otherwise(10) + v) % 97
    value = lambda c: (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1).cast("int")
    folded = F.reduce(F.transform(chars, value), F.lit(0), step)
    return F.when(F.regexp_like(F.upper(F.trim(col)), F.lit(r"\A[0-9A-Z]+\z")), folded)


def clean_text(col: Column, marker: str | None = None) -> Column:
    """Collapse white space and trim; blank and the word null become null; a trailing run of marker characters goes."""
    out = F.trim(F.regexp_replace(col, r"\s+", " "))
    if marker:
        out = F.regexp_replace(out, f"[{marker}]+\\z", "")
    return F.when((out != "") & (F.lower(out) != "null"), out)


def thousands(col: Column) -> Column:
    """A count written with thousands separators, as int; null where it is none."""
    return F.replace(col, F.lit(","), F.lit("")).try_cast("int")


def iso_date(col: Column) -> Column:
    """The date at the start of an ISO timestamp text; null where it is none."""
    return F.substring(col, 1, 10).try_cast("date")


def json_at(col: Column, place: int) -> Column:
    """The element at a place (from 0) of a JSON array in a text: texts without their quotes, others as JSON; null where there is none."""
    return F.get_json_object(col, f"$[{place}]")


def checked(col: Column, holds: Column, message: str) -> Column:
    """The value where the condition holds; where it does not, or is unknown, the query fails with the message and the value."""
    return F.when(holds, col).otherwise(F.raise_error(F.concat_ws(": ", F.lit(message), F.coalesce(col.cast("string"), F.lit("null")))))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two equally long vectors, summed in double."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


#: Cells of the character tables that one step of a batch compares at most.
_CELLS = 1 << 20


def _characters(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, a row for each, zeros after the end."""
    return np.array(texts, f"<U{max(width, 1)}").view(np.uint32).reshape(len(texts), max(width, 1))


def jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of pairs of texts: Jaro, and above 0.7 a tenth of the rest for each of up to four equal first characters.

    Pairs are taken together by their lengths. At each place of the left texts the first free equal
    character within reach is taken in all right texts at once.
    """
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a))
    order = np.lexsort((lb, la))
    at = 0
    while at < len(order):
        rows = order[at : at + max(1, _CELLS // max(1, int(la[order[at]] + lb[order[at]])))]
        width = np.maximum.accumulate(la[rows]) + np.maximum.accumulate(lb[rows])
        rows = rows[: max(1, int(np.searchsorted(width * np.arange(1, len(rows) + 1), _CELLS)))]
        at += len(rows)
        out[rows] = _together([a[i] for i in rows], [b[i] for i in rows], la[rows], lb[rows])
    return out


def _together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    x, y = _characters(a, int(la.max())), _characters(b, int(lb.max()))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    every, place = np.arange(len(a)), np.arange(y.shape[1])
    mine, taken = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    free = place < lb[:, None]
    for i in range(int(la.max())):
        can = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None]) & (i < la)[:, None]
        j = can.argmax(1)
        hit = can[every, j]
        taken[every[hit], j[hit]], free[every[hit], j[hit]], mine[hit, i] = True, False, True
    m = mine.sum(1)
    most = int(m.max(initial=0))
    first = lambda chars, marked: np.take_along_axis(chars, np.argsort(~marked, axis=1, kind="stable")[:, :most], 1)
    swaps = ((first(x, mine) != first(y, taken)) & (np.arange(most) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    alike = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    prefix = np.minimum.accumulate(alike, axis=1).sum(1)
    same = np.fromiter((p == q for p, q in zip(a, b)), bool, len(a))
    return np.where(same, 1.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))


def jaro_winkler_of(a: str, b: str) -> float:
    """jaro_winkler_batch of one pair."""
    return float(jaro_winkler_batch([a], [b])[0])


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two texts, in Arrow batches; null where either is null. Use it on distinct pairs."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = jaro_winkler_batch(x[known].tolist(), y[known].tolist())
        return pd.Series(pd.array(out, "Float64")).mask(~known)

    return run(a, b)
