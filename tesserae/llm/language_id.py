"""Operator 10, language identification with a string kernel.

A text's features are the presence of its character n-grams of every length up to NGRAM (a blended
spectrum), the text lower-cased and with each run of non-letters as one space, n-grams hashed to
2**BITS places. The kernel of two texts is their number of shared places over the root of the product
of their own numbers. Nyström: the kernel's map is taken from its values at landmarks, a fixed number
of labelled texts per language; on it one ridge regression per language against the rest is solved.
Both are linear in a text's presence vector, so landmarks, whitening and regression fold into one
weight per place and language, and a batch of texts is scored by one product of its presence matrix,
held by rows of set places, with those weights.

Only the landmarks and the regression's rows are samples, of LANDMARKS and ROWS labelled texts for
each language, those with the smallest hashes of their ids; every text is scored as a whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.llm.common import text_of

NGRAM, BITS = 4, 16
#: Labelled texts per language, at most: landmarks, and rows of the regression.
LANDMARKS, ROWS = 40, 400
#: Of all languages together, at most: each has an even share where there are many.
MOST_LANDMARKS, MOST_ROWS = 1000, 16_000
RIDGE = 1e-3
UNKNOWN = "und"
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)]


_OTHER = re.compile(r"[\W\d_]+")
#: Numbers that are no decimal digits, as in ²½Ⅳ: not of Unicode's category L, though \W leaves them.
_NUMBERS = {i: " " for i, c in enumerate(map(chr, range(sys.maxunicode + 1))) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_LATIN_NUMBERS = re.compile("[" + "".join(chr(i) for i in _NUMBERS if i < 256) + "]")


def letters(text: str) -> str:
    """The text as it is compared: lower case, each run without letters as one space, a space at both ends."""
    text = text.lower()
    if not text.isascii():
        try:
            text.encode("latin-1")
            text = _LATIN_NUMBERS.sub(" ", text)
        except UnicodeEncodeError:
            text = text.translate(_NUMBERS)
    return " " + _OTHER.sub(" ", text).strip() + " "


def places(text: str) -> np.ndarray:
    """The places that hold an n-gram of a text made by letters()."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    seen = np.zeros(1 << BITS, np.bool_)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, NGRAM + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * _MIX[0] + codes[n - 1 :] * _MIX[1] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * _MIX[2]
        seen[mixed >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def presence(found: list[np.ndarray]) -> np.ndarray:
    """A row of presence for each text's places, over the root of their number."""
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for i, at in enumerate(found):
        x[i, at] = 1 / np.sqrt(max(len(at), 1))
    return x


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, found: list[np.ndarray]) -> np.ndarray:
        """Decision values of texts, given by the places of each, one at least: a row for each text."""
        sizes = np.array([len(p) for p in found])
        sums = np.add.reduceat(self.weights[np.concatenate(found)], np.cumsum(sizes) - sizes, axis=0)
        return sums / np.sqrt(sizes)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, the score (its share of the positive parts of all decision values) and its decision value, 1 at most."""
        lang, score, value = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        clean = {i: c for i, t in enumerate(texts) if (c := letters(t)).strip()} if self.langs else {}
        if clean:
            f = self.decide([places(c) for c in clean.values()])
            best = f.argmax(1)
            top = f[np.arange(len(best)), best]
            share = np.clip(top, 1e-6, None) / np.clip(f, 1e-6, None).sum(1)
            for i, b, s, v in zip(clean, best, share, top):
                lang[i], score[i], value[i] = self.langs[b], float(min(1.0, s)), float(min(1.0, max(0.0, v)))
        return lang, score, value


def solve(found: list[np.ndarray], langs: list[str], marks: list[bool], ridge: float = RIDGE) -> Model:
    """Nyström landmarks and one ridge regression per language, from the places of each text, folded to weights of places."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    land = presence([p for p, m in zip(found, marks) if m] or found[:1])
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = np.vstack([(presence(found[k : k + 64]) @ land.T).astype(np.float64) for k in range(0, len(found), 64)]) @ whiten
    y = np.array([[1.0 if lang == n else 0.0 for n in names] for lang in langs])
    weight = (y / y.sum(0)).sum(1) / len(names)  # each language counts alike
    mean, base = weight @ z, weight @ y
    zc = (z - mean) * weight[:, None]
    beta = np.linalg.solve(zc.T @ (z - mean) + ridge * np.eye(z.shape[1]) / z.shape[1], zc.T @ (y - base))
    return Model(names, (land.T @ (whiten @ beta)).astype(np.float32), (base - mean @ beta).astype(np.float32))


def fit(
    docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", landmarks: int = LANDMARKS, rows: int = ROWS, most_rows: int = MOST_ROWS, most_landmarks: int = MOST_LANDMARKS
) -> Model:
    """Learn from rows with a language (and which allowed says may be learned from).

    For each language the rows with the smallest hashes of their ids are taken, up to `rows`, the first `landmarks` of
    them as landmarks; with so many languages that there would be more than most_rows and most_landmarks in all, each
    gets an even share. Rows of one id are one, that with the smallest text; a row without an id goes by a hash of its
    text, so that each such text counts by itself. The driver gets the places of these texts, 2**BITS at most for
    each, and holds a presence row of 2**BITS numbers for each landmark. Texts without letters teach nothing; without
    any row left, every language is unknown.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull())
    if allowed is not None:
        labelled = labelled.filter(allowed)
    text = text_of(text_col)
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit("text"))).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    keyed = labelled.select(F.col(lang_col).cast("string").alias("lang"), key.alias("_h"), text.alias("_text"))
    # only hashes that can be among the smallest go on, so what meets in a task does not grow with the input; where few hashes make up many rows, all can
    totals = keyed.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")).collect()  # a row for each language
    if not totals:
        return solve([], [], [])
    rows, landmarks = min(rows, max(8, most_rows // len(totals))), min(landmarks, max(1, most_landmarks // len(totals)))
    low = F.lit(-(2.0**63)) + F.lit(2.0**64) * (4 * rows + 100) / F.greatest(F.col("_n"), F.lit(1))
    few = keyed.select("lang", "_h").join(F.broadcast(docs.sparkSession.createDataFrame(totals)), "lang").filter(F.col("_h") <= low)
    order = Window.partitionBy("lang").orderBy("_h")
    keys = few.groupBy("lang", "_h").agg(F.lit(1).alias("_one")).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).select("lang", "_h", "_r")

    @F.pandas_udf("array<int>")
    def placed(text: pd.Series) -> pd.Series:
        return pd.Series([places(c).astype(np.int32) if (c := letters(t)).strip() else np.zeros(0, np.int32) for t in text])

    texts = keyed.join(F.broadcast(keys), ["lang", "_h"]).groupBy("lang", "_h", "_r").agg(F.min("_text").alias("_text"))
    taken = [r for r in texts.select("lang", "_r", placed("_text").alias("at")).collect() if r["at"]]
    taken.sort(key=lambda r: (r["lang"], r["_r"]))
    return solve([np.array(r["at"], np.int64) for r in taken], [r["lang"] for r in taken], [r["_r"] <= landmarks for r in taken])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column struct(lang, score, value) for each whole text: `und`, 0 and 0 for a null one or one without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each language

    @F.arrow_udf("lang string, score double, value double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for b in batches:
            found = [m.predict(b.slice(k, 16).to_pylist()) for k in range(0, len(b), 16)]  # few texts at a time are Python strings
            columns = [pa.array([x for part in column for x in part], t) for column, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))]
            yield pa.StructArray.from_arrays(columns, ["lang", "score", "value"])

    return run(text_of(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op10(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. A null doc_id is not held out."""
    out = F.coalesce(held_out(), F.lit(False))
    model = fit(docs, ~out)
    return docs.select("doc_id", out.alias("held_out"), predict(docs, model).alias("_p")).select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
