"""Operator 12, periodic run detection by recompression.

The words of many texts, with a fence between texts, become one sequence of 64-bit symbols. It is compressed in
alternation: blocks of one symbol become a symbol of their own, then pairs whose left symbol is of one half of the
alphabet (a bit of its hash at this level) and whose right symbol is of the other. Both steps look at the symbols
alone, so equal stretches are compressed alike but for their ends. The levels, with the links between them, are a
run-length grammar of the sequence. The longest common extension of two positions climbs the levels while the
symbols agree and descends where they differ, a few steps a level, for all queries of a batch at once.

A run of period q holds a stretch of words, each equal to the one q further on, of its length less q words. With s
the least length of such a stretch, every run meets the grid of the multiples of s (all grids together: n times a
harmonic sum). Where the two words of a grid point agree, extensions to both sides give the run exactly; of equal
stretches the smallest period counts. There is no suffix array, and nothing crosses tasks: the work of a text of n
words is O(n log n).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import rounds, text_of, tidy, whole_row

#: Least length of a run in words; a run is at least two periods long as well.
LEAST = 12
#: Text of so many bytes is compressed into one grammar, a longer one into its own.
GRAMMAR_BYTES = 1 << 22
#: Extension queries answered at a time.
QUERIES = 1 << 20
#: Runs of so many words or more answer the queries of their period's multiples at once.
PAINTED = 64
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _S63 = np.uint64(29), np.uint64(32), np.uint64(63)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> _S32)) * by
    return x ^ (x >> _S29)


class Grammar:
    """The levels of a recompressed sequence: symbols, the parent of each one, and the first child of each parent."""

    def __init__(self, symbols: np.ndarray, fences: np.ndarray):
        """symbols: 64-bit; those where fences is true must occur once, and are never joined. First and last must be fences."""
        self.symbols, self.parents, self.firsts = [symbols], [], []
        enough = 2 * int(fences.sum()) + 64
        while len(symbols) > enough and len(self.parents) < 400:
            n = len(symbols)
            if len(self.parents) % 2 == 0:  # blocks of one symbol
                head = np.ones(n, bool)
                np.not_equal(symbols[1:], symbols[:-1], out=head[1:])
                first = np.flatnonzero(head)
                size = np.diff(first, append=n)
                made = symbols[first]
                many = size > 1
                made[many] = _mix(made[many] * _Q + size[many].astype(np.uint64), _P)
            else:  # pairs of a left and a right symbol
                left = (_mix(symbols + np.uint64(len(self.parents)), _Q) >> _S63).astype(bool)
                second = np.zeros(n, bool)
                second[1:] = left[:-1] & ~left[1:] & ~fences[1:] & ~fences[:-1]
                head = ~second
                first = np.flatnonzero(head)
                made = symbols[first]
                pair = np.flatnonzero(second)
                at = np.searchsorted(first, pair) - 1
                made[at] = _mix(_mix(symbols[pair - 1], _P) * _Q + symbols[pair], _P)
            self.parents.append((np.cumsum(head) - 1).astype(np.int32))
            self.firsts.append(np.append(first, n).astype(np.int32))
            symbols, fences = made, fences[first]
            self.symbols.append(symbols)

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """For each query, how many symbols from i and j on agree, or, backward, how many before i and j."""
        step = 1 if forward else -1
        a, b = (i.astype(np.int64), j.astype(np.int64)) if forward else (i.astype(np.int64) - 1, j.astype(np.int64) - 1)
        top = len(self.parents)
        stopped: list[np.ndarray] = []
        live = np.arange(len(a))
        for level in range(top + 1):  # up while the symbols agree
            differ, up = [], []
            while len(live):
                x, y = a[live], b[live]
                if level < top:
                    parent, first = self.parents[level], self.firsts[level]
                    px, py = parent[x], parent[y]
                    whole = (first[px] == x) & (first[py] == y) if forward else (first[px + 1] == x + 1) & (first[py + 1] == y + 1)
                    a[live[whole]], b[live[whole]] = px[whole], py[whole]
                    up.append(live[whole])
                    live, x, y = live[~whole], x[~whole], y[~whole]
                same = self.symbols[level][x] == self.symbols[level][y]
                differ.append(live[~same])
                live, x, y = live[same], x[same], y[same]
                by = self._skip(level, x, y, forward)
                a[live], b[live] = x + step * by, y + step * by
            stopped.append(np.concatenate(differ) if differ else live)
            live = np.concatenate(up) if up else live[:0]
        for level in range(top, 0, -1):  # down where they differ
            first, below = self.firsts[level - 1], self.symbols[level - 1]
            live = stopped[level]
            if forward:
                a[live], b[live] = first[a[live]], first[b[live]]
            else:
                a[live], b[live] = first[a[live] + 1] - 1, first[b[live] + 1] - 1
            done = []
            while len(live):
                x, y = a[live], b[live]
                same = below[x] == below[y]
                done.append(live[~same])
                live, x, y = live[same], x[same], y[same]
                by = self._skip(level - 1, x, y, forward)
                a[live], b[live] = x + step * by, y + step * by
            stopped[level - 1] = np.concatenate([stopped[level - 1], *done])
        return a - i if forward else i - 1 - a

    def _skip(self, level: int, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray | int:
        """How far two equal symbols agree: to the nearer end of their blocks."""
        if level % 2 or level >= len(self.parents):
            return 1
        parent, first = self.parents[level], self.firsts[level]
        if forward:
            return np.minimum(first[parent[x] + 1] - x, first[parent[y] + 1] - y)
        return np.minimum(x - first[parent[x]], y - first[parent[y]]) + 1


def runs_of(words: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each sequence of 64-bit words: an array of (start, length, period) by start, then period."""
    order = sorted((k for k in range(len(words)) if len(words[k]) >= least), key=lambda k: -len(words[k]))
    out = [np.zeros((0, 3), np.int64) for _ in words]
    if not order:
        return out
    sizes = np.array([len(words[k]) for k in order])
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a fence first and after each text
    total = int(begins[-1] + sizes[-1] + 1)
    fences = np.ones(total, bool)
    text = np.full(total, -1, np.int32)
    symbols = _mix(np.arange(total, dtype=np.uint64) + _P, _Q)
    for k, (d, at) in enumerate(zip(order, begins)):
        symbols[at : at + len(words[d])] = words[d]
        fences[at : at + len(words[d])] = False
        text[at : at + len(words[d])] = k
    grammar = Grammar(symbols, fences)
    found = np.zeros((0, 3), np.int64)  # start, end, period
    painted = np.full(total, -1, np.int32)
    hits: list[tuple[np.ndarray, int]] = []
    waiting = 0

    def flush() -> None:
        nonlocal found, waiting
        i = np.concatenate([h for h, _ in hits])
        q = np.repeat([p for _, p in hits], [len(h) for h, _ in hits])
        hits.clear()
        waiting = 0
        right, left = grammar.extend(i, i + q, True), grammar.extend(i, i + q, False)
        rows = np.stack([i - left, i + q + right, q], 1)
        rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(2 * q, least)]
        found = np.concatenate([found, rows])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])  # of one stretch the smallest period
        found = found[new]
        for k in np.flatnonzero(found[:, 1] - found[:, 0] >= PAINTED):
            painted[found[k, 0] : found[k, 1]] = found[k, 2]

    longest, pause = int(sizes[0]), 16
    for q in range(1, longest // 2 + 1):
        last = int(np.searchsorted(-sizes, -max(2 * q, least), "right")) - 1  # texts long enough come first
        end = int(begins[last] + sizes[last])
        grid = max(q, least - q)
        i = np.flatnonzero(symbols[1 : end - q : grid] == symbols[1 + q : end : grid]) * grid + 1
        if len(i):
            i = i[text[i] == text[i + q]]
            if grid > 1:
                i = i[(symbols[i + 1] == symbols[i + q + 1]) | (symbols[i - 1] == symbols[i + q - 1])]  # else the stretch is one word
            i = i[~_answered(painted, found, i, q)]
        if len(i):
            hits.append((i, q))
            waiting += len(i)
        if hits and (waiting >= QUERIES or q >= pause):
            flush()
            pause = 2 * q
    if hits:
        flush()
    if len(found):
        owner = text[found[:, 0]]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        owner = text[found[:, 0]]
        cut = np.searchsorted(owner, np.arange(len(order) + 1))
        for k, d in enumerate(order):
            rows = found[cut[k] : cut[k + 1]]
            out[d] = np.stack([rows[:, 0] - begins[k], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return out


def _answered(painted: np.ndarray, found: np.ndarray, i: np.ndarray, q: int) -> np.ndarray:
    """Grid points that lie with their partner in a known run whose period divides q: their extension is that run."""
    p = painted[i]
    some = np.flatnonzero((p > 0) & (q % np.where(p > 0, p, 1) == 0))
    out = np.zeros(len(i), bool)
    if len(some):
        x = i[some]
        rows = found[found[:, 1] - found[:, 0] >= PAINTED]
        by_period = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
        # the run of this period that starts last at or before x; runs of one period share less than a period of words
        key = by_period[:, 2] * (len(painted) + 1) + by_period[:, 0]
        at = np.searchsorted(key, p[some].astype(np.int64) * (len(painted) + 1) + x, "right") - 1
        row = by_period[np.maximum(at, 0)]
        out[some] = (at >= 0) & (row[:, 2] == p[some]) & (row[:, 0] <= x) & (x + q < row[:, 1])
    return out


def collapse_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """The runs of each row's words and its text without their repetitions: (doc, n_words, runs, kept).

    `doc` is the row as a struct, `runs` an array of (start, length, period) by start, then period, `kept` the words
    that no run contains after its first period, joined by single spaces. Words lie between ASCII white space and are
    compared unchanged. A run is a stretch of at least `least` words and two periods, its period the smallest one,
    that no neighbouring word extends. A null or empty text has no words and no runs; each row is judged by itself,
    whatever its id; an empty table gives none.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b, texts in (part for whole in batches for part in rounds(whole, 1, GRAMMAR_BYTES)):
            words = [t.encode().split() for t in texts]
            hashed = [np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w)) for w in words]
            runs = runs_of(hashed, least)
            kept = []
            for w, r in zip(words, runs):
                if len(r):
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, r[:, 0] + r[:, 2], 1)
                    np.add.at(edge, r[:, 0] + r[:, 1], -1)
                    w = itertools.compress(w, np.cumsum(edge)[:-1] == 0)
                kept.append(b" ".join(w).decode())
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(kept, pa.string())], ["doc", "n_words", "runs", "kept"])

    rows = docs.select(whole_row(docs), text_of(text_col).alias("_text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(run, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """documents as the query's contract alters them: (doc_id, text), where every tenth id's text repeats itself from a word on.

    Ids are told apart by their crc32; a row with a null id keeps its text.
    """

    @F.arrow_udf("string")
    def altered(h: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for x, t in zip(h.to_pylist(), text):
            w = t.as_py().encode().split() if t.is_valid else []
            if w:
                g, n = x // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            out.append(b" ".join(w).decode() if t.is_valid else None)
        return pa.array(out, pa.string())

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h"))
    some = altered(F.coalesce("_h", F.lit(1)), F.when(F.col("_h") % 10 == 0, F.col("text")))
    return rows.select("doc_id", F.coalesce(some, "text").alias("text"))


def op12(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = collapse_runs(with_repeats(docs))
    longest = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length != y.length THEN CAST(sign(y.length - x.length) AS INT) WHEN x.start != y.start THEN CAST(sign(x.start - y.start) AS INT) ELSE CAST(sign(x.period - y.period) AS INT) END)[0]")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("_r", F.when(F.size("runs") > 0, longest)).select(
        "doc.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_r.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _r.length div _r.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
