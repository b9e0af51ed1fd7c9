"""Operator 8, line de-duplication.

Line keys are hashed to 128 bits and range-partitioned by (hash, document, position), so that even a
line of every document is dealt over many tasks. Each task streams its sorted rows, holds one run's
state, and marks the lines that come after their first document. The run at the start of a task may
have begun in an earlier one: its rows wait for the first document of that hash over all tasks, of
which each task reports at most two. Back come compressed bitmaps of the lines that each document
keeps; only where they are applied is a text read again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WHITE, id_of, rounds, row_hash, slots, text_of, tidy, whole_row
from tesserae.session import written

#: Keys of fewer code points are never dropped.
MIN_CHARS = 10
#: What a row of the stream says: its line goes; its run began earlier, perhaps; the first document of a run at a task's edge.
DROP, WAIT, EDGE = 1, 0, 2


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hash, document and position of every line whose key is long enough: (h1, h2, id, row, pos, n_lines)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in (part for whole in batches for part in rounds(whole, 2)):
            hashes, lines, found = [], [], []
            for text in texts:
                rows = text.encode().split(b"\n")
                n = 0
                for pos, line in enumerate(rows):
                    key = line.strip().lower()  # of bytes: ASCII white space and A-Z alone
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                        lines.append(pos)
                        n += 1
                found.append((n, len(rows)))
            per = np.array(found, np.int64).reshape(-1, 2)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            again = lambda x: np.repeat(x, per[:, 0])
            columns = [h[:, 0], h[:, 1], again(b.column(0).to_numpy()), again(b.column(1).to_numpy()), np.array(lines, np.int32), again(per[:, 1]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h1", "h2", "id", "row", "pos", "n_lines"])

    return docs.select("_id", "_row", "_text").mapInArrow(run, "h1 long, h2 long, id long, row long, pos int, n_lines int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of sorted rows; between batches only the current run's hash and first document are held."""
    run = first = None  # (h1, h2) and document
    head = True  # still in the first run of the task
    names = ["h1", "h2", "id", "row", "pos", "n_lines", "said"]

    def edge(key: tuple[int, int], doc: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, doc, 0, 0, 0, EDGE), (pa.int64(),) * 4 + (pa.int32(),) * 3)], names)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = run != (int(h1[0]), int(h2[0]))
        starts = np.flatnonzero(new)
        firsts = doc[starts]
        if not new[0]:
            firsts = np.concatenate([[first], firsts])
        of_row = np.cumsum(new) - new[0]
        waits = np.zeros(len(h1), bool)
        if head:
            if run is None:
                yield edge((int(h1[0]), int(h2[0])), int(doc[0]))
                waits[of_row == 0] = True
            else:
                waits[of_row == 0] = not new[0]
            head = bool(waits[-1])
        said = np.where(waits, WAIT, DROP).astype(np.int32)
        keep = waits | (doc != firsts[of_row])
        run, first = (int(h1[-1]), int(h2[-1])), int(firsts[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns] + [pa.array(said[keep])], names)
    if run is not None and not head:
        yield edge(run, first)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines the documents that lose any keep: (id, row, n_lines, n_dropped, keep_bitmap).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of min_chars
    code points or more that two documents hold go from all but the smallest id. The bitmap is zlib
    over a 32-bit count of lines and one bit for each, 1 where it stays. Rows that share an id are one
    document; `row` tells their texts apart. A null id is after all others; a null or empty text is
    one empty line. Documents that lose nothing, and empty tables, give no rows.
    """
    rows = docs.select(id_of(id_col).alias("_id"), row_hash(text_col).alias("_row"), text_of(text_col).alias("_text"))
    lines = written(line_keys(rows, min_chars), "lines")  # else the ranges' sampling would split all texts once more
    ordered = lines.repartitionByRange(slots(docs), "h1", "h2", "id", "pos").sortWithinPartitions("h1", "h2", "id", "pos")
    marks = written(ordered.mapInArrow(_stream, "h1 long, h2 long, id long, row long, pos int, n_lines int, said int"), "marks")
    firsts = marks.filter(F.col("said") == EDGE).groupBy("h1", "h2").agg(F.min("id").alias("_first"))  # two rows for each task at most
    waited = marks.filter(F.col("said") == WAIT).join(F.broadcast(firsts), ["h1", "h2"]).filter("id != _first")
    drops = marks.filter(F.col("said") == DROP).unionByName(waited.select(*marks.columns)).select("id", "row", "n_lines", "pos").distinct()

    @F.pandas_udf("binary")
    def bitmap(n: pd.Series, gone: pd.Series) -> pd.Series:
        def one(count: int, at: np.ndarray) -> bytes:
            bits = np.ones(count, np.uint8)
            bits[at] = 0
            return zlib.compress(struct.pack("<I", count) + np.packbits(bits).tobytes())

        return pd.Series([one(c, a) for c, a in zip(n, gone)])

    per = drops.groupBy("id", "row", "n_lines").agg(F.collect_list("pos").alias("_gone"))  # at most the lines of one document
    return per.select("id", "row", "n_lines", F.size("_gone").cast("long").alias("n_dropped"), bitmap("n_lines", "_gone").alias("keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as a struct `doc`, with n_lines, n_dropped and `kept`, the text of the lines that stay."""

    def one(t: str, b: bytes | None) -> str:
        if b is None:
            return t
        data = zlib.decompress(b)
        stays = np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=struct.unpack_from("<I", data)[0])
        return "\n".join(line for line, s in zip(t.split("\n"), stays) if s)

    @F.arrow_udf("string")
    def kept(text: pa.Array, bits: pa.Array) -> pa.Array:
        return pa.array((one(t.as_py(), b.as_py()) for t, b in zip(text, bits)), pa.string())

    marked = docs.select(whole_row(docs), id_of(id_col).alias("_id"), row_hash(text_col).alias("_row"), text_of(text_col).alias("_text"))
    joined = marked.join(bitmaps.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("keep_bitmap").alias("_bits"), F.col("n_dropped").alias("_n")), ["_id", "_row"], "left")
    n = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "doc",
        n.cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_bits").isNull(), F.col("_text")).otherwise(kept("_text", "_bits")).alias("kept"),
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their text less the repeated lines, other columns as they were.

    Documents of which nothing but white space is left after they lost a line go. A null text becomes empty.
    """
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, id_col, text_col), id_col, text_col)
    out = out.filter((F.col("n_dropped") == 0) | (F.trim(F.translate("kept", WHITE, " " * len(WHITE))) != ""))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
