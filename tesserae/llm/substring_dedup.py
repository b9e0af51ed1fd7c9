"""Operator 11, substring de-duplication by relative Lempel-Ziv parsing.

Each stretch of some megabytes of texts is a reference block. Its index is the sorted list of the hashes of all its
windows of `window` words, with document and position. The indexes are dealt by ranges of the hash, so that each range
of a document's windows meets that range of every block's index at once, and finds the first document that has it,
and where. With these references a document is parsed greedily: from the first window that the reference has, a
factor goes on as long as the next window continues it at the same source. What no window covers are literals.
Factors have `window` words at least; where one ends because its source does, the windows over the boundary have been
looked up like all others, so a next factor begins inside it, and spans are the union of both.

A block sends a window once for its smallest document; what repeats it in the block needs no look-up and is dealt by
document, so a window of every document is an entry per block. Entries cross the shuffle as compressed planes
(packed.py), a row for each block and range. All windows are looked up; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import id_of, rounds, row_hash, slots, text_of, tidied, tidy
from tesserae.llm.packed import cuts, joined, mix, pack, range_of, unpack
from tesserae.session import written

#: Words in a window.
WINDOW = 13
#: Bytes of text in a reference block, and for a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 1 << 23, 24_000_000

FACTORS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "source", "source_start")]))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """The 64-bit hash of each `window` consecutive words, from those of the words, by doubling."""
    out, done, size, power = None, 0, 1, h
    while True:
        if window & size:
            n = len(h) - done - size + 1
            if n <= 0:
                return h[:0]
            out = power if out is None else joined(out[:n], power[done : done + n])
            done += size
        if 2 * size > window:
            return out
        power = joined(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def _first(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries sorted by hash: which ones a smaller document has too, and, for these, the smallest document and its first position."""
    n = len(h)
    head = np.ones(n, bool)
    head[1:] = h[1:] != h[:-1]
    tail = np.append(head[1:], True)
    many = np.flatnonzero(~(head & tail))
    sub = many[np.lexsort((pos[many], ids[many], h[many]))]
    begin = np.ones(len(sub), bool)
    begin[1:] = h[sub][1:] != h[sub][:-1]
    lead = sub[np.flatnonzero(begin)[np.cumsum(begin) - 1]] if len(sub) else sub
    later = ids[sub] > ids[lead]
    return sub[later], ids[lead[later]], pos[lead[later]]


def _index(parts: int, window: int, block: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b, texts in (part for whole in batches for part in rounds(whole, 2, block)):
            hashed = [np.fromiter(map(xxh3_64_intdigest, w), np.uint64, len(w)) for w in (t.encode().split() for t in texts)]
            n = np.array([len(x) for x in hashed])
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            h = window_hashes(np.concatenate(hashed), window)
            whole = (pos <= n[doc] - window)[: len(h)]
            h, doc, pos = h[whole], doc[: len(whole)][whole], pos[: len(whole)][whole]
            order = np.argsort(h)
            h, doc, pos = h[order], doc[order], pos[order]
            ids, rows = b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            known, source, at = _first(h, ids, pos)
            said: dict[int, list[bytes | None]] = {}
            if len(known):
                part = range_of(mix(mix(ids[known].view(np.uint64)) ^ rows[known].view(np.uint64)), parts)
                order = np.argsort(part, kind="stable")
                for k, i, j in zip(*_slices(part[order])):
                    x = order[i:j]
                    said[int(k)] = [None, pack(ids[known[x]], rows[known[x]], pos[known[x]], source[x], at[x])]
            alone = np.ones(len(h), bool)
            alone[known] = False
            h, ids, rows, pos = h[alone], ids[alone], rows[alone], pos[alone]
            for k, i, j in zip(*_slices(range_of(h, parts))):
                data = pack(np.diff(h[i:j], prepend=np.uint64(0)), ids[i:j] - ids[i], rows[i:j], pos[i:j], np.full(j - i, ids[i]))
                said.setdefault(int(k), [None, None])[0] = data
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(said), pa.int32()), pa.array([x for x, _ in said.values()], pa.binary()), pa.array([x for _, x in said.values()], pa.binary())], ["part", "entries", "known"]
            )

    return run


def _slices(parts: np.ndarray) -> tuple[list[int], ...]:
    which, at = cuts(parts)
    return which.tolist(), at[:-1].tolist(), at[1:].tolist()


def _stacked(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    found = [unpack(x.as_buffer(), np.int64) for x in column if x.is_valid]
    return [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(width)]


def _look_up(parts: int):
    """Of a range of hashes: the windows that a smaller document has, dealt by document."""

    @tidied
    def run(table: pa.Table) -> pa.Table:
        chunks = [unpack(x.as_buffer(), np.int64) for x in table.column("entries") if x.is_valid]
        for c in chunks:
            c[0] = np.cumsum(c[0].view(np.uint64), dtype=np.uint64)
            c[1] = c[1] + c[4]
        h, ids, rows, pos = (np.concatenate([c[k] for c in chunks]) if chunks else np.zeros(0, np.int64) for k in range(4))
        order = np.argsort(h)
        h, ids, rows, pos = h[order], ids[order], rows[order], pos[order]
        found, source, at = _first(h, ids, pos)
        known = _stacked(table.column("known"), 5)
        ids, rows, pos, source, at = (np.concatenate(c) for c in zip((ids[found], rows[found], pos[found], source, at), known))
        part = range_of(mix(mix(ids.view(np.uint64)) ^ rows.view(np.uint64)), parts)
        order = np.lexsort((pos, rows, ids, part))
        made = [(k, pack(*(c[order[i:j]] for c in (ids, rows, pos, source, at)))) for k, i, j in zip(*_slices(part[order]))]
        return pa.table({"part": pa.array([k for k, _ in made], pa.int32()), "found": pa.array([x for _, x in made], pa.binary())})

    return run


def _parse(window: int):
    """Of a share of the documents: their factors, a row per document."""

    @tidied
    def run(table: pa.Table) -> pa.Table:
        ids, rows, pos, source, at = _stacked(table.column("found"), 5)
        order = np.lexsort((pos, rows, ids))
        ids, rows, pos, source, at = (c[order] for c in (ids, rows, pos, source, at))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
        # repeated rows say the same twice
        fresh = np.ones(len(ids), bool)
        fresh[1:] = new[1:] | (pos[1:] != pos[:-1])
        ids, rows, pos, source, at, new = (c[fresh] for c in (ids, rows, pos, source, at, new))
        begin = new.copy()
        begin[1:] |= (pos[1:] != pos[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(begin)
        length = np.diff(first, append=len(ids)) + window - 1
        doc = np.flatnonzero(new[first])
        factors = pa.StructArray.from_arrays([pa.array(c) for c in (pos[first], length, source[first], at[first])], ["start", "length", "source", "source_start"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(doc, len(first)), pa.int32()), factors)
        return pa.table({"id": pa.array(ids[first[doc]]), "row": pa.array(rows[first[doc]]), "factors": lists})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, int]:
    """Rows (_id, _row, _text), the column for _row, and how many ranges the hashes are dealt to."""
    ids = docs.select(id_of(id_col).alias("_id"), F.octet_length(text_of(text_col)).cast("long").alias("_n"))
    per = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_c"), F.sum("_n").alias("_n")).agg(F.max("_c"), F.sum("_n")).first()
    row = row_hash(text_col) if (per[0] or 0) > 1 else F.lit(0).cast("long")
    parts = max(slots(docs), -(-(per[1] or 0) // RANGE_BYTES))
    return docs.select(id_of(id_col).alias("_id"), row.alias("_row"), text_of(text_col).alias("_text")), row, parts


def _factors(rows: DataFrame, parts: int, window: int) -> DataFrame:
    entries = rows.mapInArrow(_index(parts, window, BLOCK_BYTES), "part int, entries binary, known binary")
    found = entries.groupBy("part").applyInArrow(_look_up(parts), "part int, found binary")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("factors", FACTORS)])
    return written(found.groupBy("part").applyInArrow(_parse(window), schema), "factors")


def factors(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factors of each document against all documents with smaller ids: (id, row, factors), documents with any alone.

    A factor is (start, length, source, source_start): `length` words from `start` on stand in the document
    `source` from `source_start` on, words counted from 0. The source of a window is the smallest id that has it in
    the document's own block, where that is smaller than its own, or else the smallest of all, at its first place
    there; which words are covered doesn't depend on blocks. `row` tells texts that share an id apart, and is 0 where ids are unique.
    Windows are compared by 64-bit hashes. A null id is after all others; rows that share an id, null ones among
    them, are no reference for each other. Texts of fewer than `window` words, null and empty ones have no factors.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    rows, _, parts = _rows(docs, id_col, text_col)
    return _factors(rows, parts, window)


@tidy
def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the one shuffle that they take."""
    codec = pa.Codec("zstd", compression_level=3)
    for b, texts in (part for whole in batches for part in rounds(whole, 3)):
        data = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in (t.encode() for t in texts)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(data, pa.binary())], ["doc", "_id", "_row", "_text"])


@tidy
def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, compressed text, factors): the words outside factors."""
    codec = pa.Codec("zstd")
    for b, texts in (part for whole in batches for part in rounds(whole, 1)):
        n, left, out = [], [], []
        for data, f in zip(texts, b.column(2)):
            words = codec.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True).split()
            n.append(len(words))
            if f.is_valid:
                start, length = (f.values.field(k).to_numpy() for k in range(2))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                words = list(compress(words, np.cumsum(edge)[:-1] == 0))
            left.append(len(words))
            out.append(b" ".join(words).decode())
        counts = [pa.array(n, pa.int64()), pa.array(np.array(n, np.int64) - np.array(left, np.int64))]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(out, pa.string())], ["doc", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row without the words that windows of a document with a smaller id cover: (doc, n_words, n_removed, kept).

    `doc` is the row as a struct without its text, `kept` the words left, joined by single spaces. Words lie between
    ASCII white space and are compared unchanged; all windows are judged on the input. For null and repeated ids and
    null texts see factors(). One row for each row; an empty table gives none.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    rows, row, parts = _rows(docs, id_col, text_col)
    found = _factors(rows, parts, window)
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    plain = docs.select(other.alias("doc"), id_of(id_col).alias("_id"), row.alias("_row"), text_of(text_col).alias("_text"))
    doc, field = plain.schema["doc"], T.StructField
    texts = plain.mapInArrow(_squeezed, T.StructType([doc, field("_id", T.LongType()), field("_row", T.LongType()), field("_text", T.BinaryType())]))
    # a merge join at any size: factors grow with the input and are never broadcast
    both = texts.join(found.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "factors").hint("merge"), ["_id", "_row"], "left")
    schema = T.StructType([doc, field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept", T.StringType())])
    return both.select("doc", "_text", "factors").mapInArrow(_applied, schema)


def op11(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    out = substring_dedup(docs.select("doc_id", "text"))
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, md5(win) AS win FROM (SELECT doc_id, i, string_agg(word, ' ') OVER q AS win, count(*) OVER q AS n FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT g.doc_id, g.i, unnest(range(13)) AS k FROM g JOIN f USING (win) WHERE f.first < g.doc_id)),
m AS (SELECT w.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (c.i IS NULL), '') AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(m.n_words, 0) AS n_words, coalesce(m.n_removed, 0) AS n_removed, sha256(coalesce(m.kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)
"""
