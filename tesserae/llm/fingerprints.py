"""Operator 3, document fingerprints by spot signatures.

Each common word (anchor) of a text begins a signature: the anchor and the chain of content words that
follow it. Where anchors are missing, as in a language that has none listed, content words chosen by their
hash begin signatures too, so that no stretch of GAP words is left out. A fingerprint is the set of a text's
signatures. The search of all fingerprints, near_components, deals them out by partitions of set length,
where a set can only reach the threshold with sets of its own and the two next partitions, and prunes
within by prefixes, positions and parities before whole sets are compared; it shares that join with
operator 2. The query compares the pairs that its contract names, each with the exact coefficient.

To compare each document with the next one, ids are cut into ranges and every range also gets the
first document of the one after it, so that all texts move once and no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import LAST_ID, id_back, id_of, row_hash, slots, text_of, tidy
from tesserae.llm.ngram_join import set_components

#: Fixed list: anchors, common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in that is was for it a be are by on with as at this from or an "
    "der die das und den dem ein eine einen ist mit sich von zu auf für im nicht "
    "le la les de des du un une et est en que qui dans pour par sur au "
    "el los las del y una por con para su se lo al".split()
)
#: Content words in a chain, and the step from one to the next.
CHAIN, STEP = 3, 1
#: Of any so many content words in a row without an anchor, the one with the smallest hash is one; in a text without anchors, of any CHAIN * STEP + 1.
GAP = 8
_WORD = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """The hash of each word met, made once; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode())
        return h


def hashed_spots(h: np.ndarray, ends: list[int], gap: int) -> list[int]:
    """Of each `gap` content words in a row between two of the ends the place of the first with the smallest hash."""
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < gap and len(least):
        step = min(size, gap - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = np.arange(len(least))
    stops = np.array(ends, np.int64)
    within = at + gap <= stops[np.searchsorted(stops, at, "right")] if len(at) else at > 0
    return np.unique(least[within] & np.uint64(0xFFFFFFFF)).tolist()


def signatures(text: str, chain: int = CHAIN, step: int = STEP, anchors: frozenset[str] = ANCHORS, hashes: WordHashes | None = None) -> np.ndarray:
    """The sorted 32-bit hashes of a text's signatures.

    The start of the text counts as an anchor, so any text with a word has a signature; chains at the
    end are shorter. Stretches of GAP or more content words have anchors by hash; in a text without an
    anchor all that are longer than a chain have, so its signatures are not those of its start alone. A text of other symbols alone has the hash of its symbols, white space aside; an
    empty one none.
    """
    words = _WORD.findall(text.lower())
    if not words:
        rest = "".join(text.split())
        return np.array([zlib.crc32(rest.encode())] if rest else [], np.uint32)
    marks = [k for k, w in enumerate(words) if w in anchors]
    content = [w for w in words if w not in anchors] if marks else words
    if not marks and not content:
        return np.zeros(0, np.uint32)
    spots = [("^", 0), *((words[k], k - j) for j, k in enumerate(marks))]
    reach = chain * step
    hashes = WordHashes() if hashes is None else hashes
    gap = GAP if marks else reach + 1
    ends = [i for _, i in spots] + [len(content)]
    if any(stop - start >= gap for start, stop in zip(ends, ends[1:])):
        h = np.fromiter(map(hashes.__getitem__, content), np.uint32, len(content))
        spots += [(content[i], i + 1) for i in hashed_spots(h, ends, gap)]
    found = {" ".join((a, *content[i : i + reach : step])) for a, i in spots}
    return np.sort(np.fromiter((zlib.crc32(x.encode()) for x in found), np.uint32, len(found)))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Shared over all signatures of two sorted distinct arrays; 0 where it is under the threshold. Two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small < threshold * large or not small:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    value = shared / (len(both) - shared)
    return value if value >= threshold else 0.0


def packed(signs: np.ndarray) -> str:
    """A fingerprint as text: the hex of its signatures in order."""
    return np.unique(signs).astype(">u4").tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each whole text: (id, fingerprint, n_signatures). A null or empty text has an empty one."""

    @F.pandas_udf("fingerprint string, n_signatures long")
    def run(text: pd.Series) -> pd.DataFrame:
        found = [signatures(t) for t in text]
        return pd.DataFrame({"fingerprint": [packed(s) for s in found], "n_signatures": [len(np.unique(s)) for s in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), run(text_of(text_col)).alias("_f"))
    return rows.select("id", "_f.fingerprint", "_f.n_signatures")


def _elements(text: str) -> np.ndarray:
    return np.unique(signatures(text)).astype(np.int64)


def near_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose fingerprints reach percent / 100, by component: (id, n_elements, component_id, class_id).

    Sets meet only in partitions of length that allow the threshold, and only on their rarest signatures;
    see ngram_join.set_components for the cases. Texts of equal signatures are one class.
    """
    return set_components(docs, _elements, percent, id_col, text_col)


def range_cuts(quantiles: list[float]) -> list[tuple[int, int]]:
    """Where ranges of (id, row) begin, from quantiles of the ids: an id that several quantiles fall on is cut evenly by the hashes of its rows."""
    ids, times = np.unique(np.array([min(int(q), LAST_ID) for q in quantiles], np.int64), return_counts=True)
    return [(int(i), -(1 << 63) + (k << 64) // int(n)) for i, n in zip(ids, times) for k in range(n)]


def place(cuts: list[tuple[int, int]], ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many cuts are at or before each (id, row)."""
    out = np.searchsorted(np.array([i for i, _ in cuts], np.int64), ids, "left")
    for i in {i for i, _ in cuts}:
        own = ids == i
        out[own] += np.searchsorted(np.array([r for j, r in cuts if j == i], np.int64), rows[own], "right")
    return out


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in ranges of ids: (_part, _ahead, _id, _row, _text), sorted in each partition.

    docs has _id, _row and _text. `_ahead` marks the first row of the next range that has any (after
    the last one: of the first), which stands at the end of its range.
    """
    spark = docs.sparkSession
    ids = docs.select("_id", "_row")
    cuts = range_cuts(ids.approxQuantile("_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else [])

    def part(i, row):
        @F.pandas_udf("int")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(place(cuts, x.to_numpy(np.int64), y.to_numpy(np.int64)).astype(np.int32))

        return run(i, row)

    firsts = ids.groupBy(part(F.col("_id"), F.col("_row")).alias("_part")).agg(F.min(F.struct("_id", "_row")).alias("_f")).orderBy("_part").collect()  # a row for each range
    ahead = [(firsts[k - 1]["_part"], firsts[k]["_f"]["_id"], firsts[k]["_f"]["_row"]) for k in range(len(firsts))]
    sent = spark.createDataFrame(ahead, "_to int, _id long, _row long")
    placed = docs.withColumn("_part", part(F.col("_id"), F.col("_row")))
    joined = placed.join(F.broadcast(sent), ["_id", "_row"], "left")
    own = F.struct(F.col("_part").alias("to"), F.lit(False).alias("ahead"))
    more = F.struct(F.col("_to").alias("to"), F.lit(True).alias("ahead"))
    dealt = joined.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, more))))
    dealt = dealt.select(F.col("_at.to").alias("_part"), F.col("_at.ahead").alias("_ahead"), "_id", "_row", "_text")
    return dealt.repartitionById(max(1, parts), F.col("_part")).sortWithinPartitions("_part", "_ahead", "_id", "_row")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document, by ascending id.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Rows of one
    id follow each other by a hash of their text; a null id is after all others; the last document is
    followed by the first, a single one by itself. A null text is empty. No rows give none.
    """
    rows = docs.select(id_of(id_col).alias("_id"), row_hash(text_col).alias("_row"), text_of(text_col).alias("_text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in schema.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # range, id, text, signatures of the row before
        hashes = WordHashes()
        for b in batches:
            out = []
            for part, ahead, i, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4))):
                own = np.unique(signatures(text, hashes=hashes))
                if before and before[0] == part:
                    _, j, prior, signs = before
                    changed = edited(prior, text)
                    other = np.unique(signatures(changed, hashes=hashes))
                    out.append((j, len(prior), hashlib.sha256(changed.encode()).hexdigest(), packed(signs), packed(other), pruned_jaccard(signs, other), pruned_jaccard(signs, own)))
                before = None if ahead else (part, i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return with_next(rows, slots(docs)).mapInArrow(run, schema).withColumn("id", id_back("id"))


def op3(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the columns of compare_with_next."""
    return compare_with_next(docs).withColumnRenamed("id", "doc_id")
