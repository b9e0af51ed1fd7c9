"""Operator 6, best-fit packing by matching large items.

What may go together depends on lengths alone, and no piece is longer than the capacity. So the plan
is made on the histogram of lengths, at most `capacity` counts whatever the input: pieces longer than
a third of the capacity are matched greedily, at most two to a bin, the longest with the longest that
fits; shorter ones, longest first, go to the smallest gap that holds them. The plan is a table of
ranges: the pieces of length L that rank from r on take the bins from b on at an offset. Pieces get
their rank among those of their length from sums over (length, salt) groups, so no length, however
frequent, is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import TEXT, encoder
from tesserae.llm.common import rounds, slots, text_of, tidy
from tesserae.session import written

CAPACITY = 4096
#: The id after each document.
END = 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded documents in pieces of at most capacity ids: (id, piece, start, length, ids_crc32).

    The ids of the whole text, then the end id. A null or empty text is the end id alone.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b, texts in (part for whole in batches for part in rounds(whole, most=TEXT)):
            ids, sizes = enc.batch(texts)
            ends = np.cumsum(sizes)
            data = memoryview(np.insert(ids, ends, end).astype("<u4"))  # each document's end id after its own
            sizes = sizes + 1
            n_pieces = -(-sizes // capacity)
            piece = np.arange(n_pieces.sum()) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(np.repeat(sizes, n_pieces) - start, capacity)
            at = np.repeat(ends + np.arange(len(ends)) + 1 - sizes, n_pieces) + start
            crc = [zlib.crc32(data[a:z]) for a, z in zip(at.tolist(), (at + length).tolist())]
            row = pa.array(np.repeat(np.arange(len(sizes)), n_pieces))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, last rank, first bin, offset) that pack counts[length] pieces of each length.

    `open` holds, by gap, kinds of bin: (first bin, number of bins, fill). Bins of one kind are alike,
    so each step fills all or a part of a kind and its cost doesn't depend on the number of pieces.
    """
    out: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    open_: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n - 1, first, offset))
        used[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, n))

    large = [n for n in lengths if 3 * n > capacity]
    for a in reversed(large):
        while left[a]:
            fits = bisect_left(large, capacity - a + 1) - 1
            while fits >= 0 and not left[large[fits]]:
                large.pop(fits)
                fits -= 1
            mate = large[fits] if fits >= 0 and (large[fits] != a or left[a] > 1) else next((n for n in reversed(large[: max(fits, 0)]) if left[n]), 0)
            if not mate:
                n = left[a]
                put(a, n, bins, 0)
                keep(capacity - a, bins, n)
            else:
                n = left[a] // 2 if mate == a else min(left[a], left[mate])
                put(a, n, bins, 0)
                put(mate, n, bins, a)
                keep(capacity - a - mate, bins, n)
            bins += n
    for s in reversed([n for n in lengths if 3 * n <= capacity]):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                per = capacity // s
                n = -(-left[s] // per)
                keep(capacity, bins, n)
                bins += n
                continue
            gap = gaps[at]
            first, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap], gaps[at]
            per = min(gap // s, left[s])
            take = min(n, left[s] // per)
            for k in range(per):
                put(s, take, first, capacity - gap + k * s)
            keep(gap - per * s, first, take)
            keep(gap, first + take, n - take)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A place for every piece: the columns of parts, sequence_id and offset.

    parts needs `length` (1 to capacity), `id` and `piece`. Pieces of one length are alike, so ties
    are free; they go by salt, id and piece. Salts are dealt by row and written with the pieces, so that
    pieces of one id, or without any, are spread as all others. No pieces give no rows.
    """
    spark = parts.sparkSession
    salts = max(16, slots(parts))
    parts = written(parts.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(salts))), "pieces")
    groups = written(parts.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    ranges = spark.createDataFrame(plan(counts, capacity), "_len long, _from long, _to long, _bin long, offset long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("length", "_salt", before.alias("_start"))
    within = Window.partitionBy("length", "_salt").orderBy("id", "piece")
    ranked = parts.withColumn("_r", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_r"))
    placed = ranked.join(F.broadcast(ranges), (F.col("length") == F.col("_len")) & F.col("_rank").between(F.col("_from"), F.col("_to")))
    return placed.withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_from")).drop("_salt", "_r", "_rank", "_start", "_len", "_from", "_to", "_bin")


def op6(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    placed = pack(pieces(docs, path))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
