"""Operator 7, WARC archives with an index first.

Tasks write records as gzip members, to archives of a bounded size of their own, in the shared folder, and
return an index row for each: file, offset, length, URL and digest. The committed index alone says
which archives count, so an attempt that was lost leaves a file that nobody reads. Records are read
back through the index: the selected rows are dealt by file and stretch of it and sorted by offset, near
ranges are coalesced, and each coalesced range is one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_back, id_of, row_hash, slots
from tesserae.session import fresh_path, written

#: Equal payloads of fewer bytes are not shared.
MIN_BYTES = 0
#: Ranges whose gap is at most so many bytes are read together, up to so many bytes.
GAP, MOST = 1 << 16, 8 << 20
#: Bytes after which a task begins a next archive, and of an archive's stretches that are dealt to tasks.
ARCHIVE_BYTES, STRETCH = 1 << 30, 1 << 26
#: Fixed by the format: the profile of a revisit, and an instant for records that have none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNDATED = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(path: str):
    """The file system and the place in it of a path: local, or any that Arrow knows by its scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit carries no payload but the length and digest of the whole one."""
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {UNDATED}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record does not start where the index says")
    found = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(found["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return found, rest[:n]


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Which page each page revisits: (_id, _row, _refers). Of equal payloads the largest id is none's revisit."""
    slim = written(pages.select("_id", "_row", F.octet_length("_html").alias("_bytes"), F.sha1(F.encode("_html", "UTF-8")).alias("_sha")), "payloads")
    best = written(slim.filter(F.col("_bytes") >= min_bytes).groupBy("_sha").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "repeated")
    again = slim.filter(F.col("_bytes") >= min_bytes).join(best, "_sha").filter("_id < _best")
    return again.select("_id", "_row", F.col("_best").alias("_refers")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row, to archives of about archive_bytes at most, and return the index (file, offset, length, url, digest, page_id).

    The payload is the html in UTF-8, a null one empty; a null url is empty, and white space in one is
    percent-encoded, as a header ends with its line. A null id stands after all others and is written
    as the largest long. Rows repeated with one id are each written.
    """
    rows = pages.select(id_of(id_col).alias("_id"), row_hash(html_col).alias("_row"), F.coalesce(url_col, F.lit("")).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    marked = rows.join(revisits(rows, min_bytes), ["_id", "_row"], "left").select("_id", "_refers", "_url", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        fs.create_dir(place, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            found = []
            for i, refers, url, html in zip(*(c.to_pylist() for c in b.columns)):
                out = out or fs.open_output_stream(f"{place}/{name}", compression=None)
                url = "".join("".join(f"%{x:02X}" for x in c.encode()) if c.isspace() or ord(c) < 32 else c for c in url)
                payload = html.encode()
                digest = digest_of(payload)
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = gz.compress(record(i, url, payload, digest, refers)) + gz.flush()
                out.write(data)
                found.append((name, at, len(data), url, digest, i))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
            if found:
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["file", "offset", "length", "url", "digest", "page_id"])
        if out:
            out.close()

    return marked.mapInArrow(run, INDEX)


def coalesced(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, int, int]]:
    """Reads for sorted (offset, length) rows: (first row, row after the last, start, end)."""
    first = 0
    end = 0
    for i, (at, n) in enumerate(rows):
        if i > first and (at - end > gap or at + n - rows[first][0] > most):
            yield first, i, rows[first][0], end
            first, end = i, 0
        end = max(end, at + n)
    if rows:
        yield first, len(rows), rows[first][0], end


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index rows name: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    A response's digest and length are those of the bytes read, which must agree with the index; a
    revisit's are those of its header, and its payload is null. Without payloads that column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        name = file = None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            start = 0
            while start < len(rows):
                stop = next((i for i in range(start, len(rows)) if rows[i][0] != rows[start][0]), len(rows))
                if rows[start][0] != name:
                    if file:
                        file.close()
                    name = rows[start][0]
                    file = fs.open_input_file(f"{place}/{name}")
                part = rows[start:stop]
                for i, j, lo, hi in coalesced([(r[1], r[2]) for r in part]):
                    file.seek(lo)
                    data, out = file.read(hi - lo), []
                    for _, at, n, digest in part[i:j]:
                        head, block = parse(zlib.decompress(data[at - lo : at - lo + n], 31))
                        page = int(head["warc-record-id"][len("<urn:page:") : -1])
                        refers = head.get("warc-refers-to")
                        stated = head["warc-payload-digest"].removeprefix("sha1:")
                        own = stated if refers else digest_of(block)
                        if own != stated or own != digest:
                            raise ValueError(f"the payload of page {page} does not have its digest")
                        size = int(head["x-payload-length"]) if refers else len(block)
                        out.append((page, head["warc-target-uri"], head["warc-type"], int(refers[len("<urn:page:") : -1]) if refers else None, size, own, None if refers or not payloads else block))
                    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                start = stop
        if file:
            file.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    chosen = index.select("file", "offset", "length", "digest").repartition(slots(index), F.col("file"), stretch).sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(run, RECORD)


def op7(pages: DataFrame) -> DataFrame:
    """One row per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = written(write_archives(pages, folder), "warc-index")
    out = read_records(index, folder, payloads=False)
    return out.select(id_back("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM p),
bits AS (SELECT hex, list_reduce(list_prepend('', list_transform(range(1, 41), lambda i: lpad(bin(CAST(instr('0123456789abcdef', hex[i]) - 1 AS INTEGER)), 4, '0'))), lambda a, x: a || x) AS z FROM (SELECT DISTINCT hex FROM p)),
d AS (SELECT hex, list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(z[CAST(5 * i + j + 1 AS INTEGER)] AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER)])), lambda a, x: a || x) AS payload_digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b JOIN d USING (hex)
"""
