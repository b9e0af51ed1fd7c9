"""Sources: Parquet, delimited text aligned by name, lines, fixed width, JSON forms, archives, pages, file inventories."""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: quoted links, a scheme, and the authority of a URL.
HREF = r"""(?i)href\s*=\s*["']([^"']*)["']"""
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"
ORIGIN = r"\A([^:/?#]+://[^/?#]+)"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text_csv(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Delimited text with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, quote=quote, escape=quote, multiLine=True)


def read_delimited_by_name(spark: SparkSession, paths: Sequence[str], sep: str = "\t", quote: str = '"') -> DataFrame:
    """Several delimited files, columns aligned by the names in their headers; absent ones are null.

    paths are files, folders or globs. Files with equal headers share one reader, as a glob over different headers
    aligns by position. All headers are read in one job, a line of each file; empty files are left out, and none with
    a header is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for f in frames for p in f["path"]):
            system, place = file_system(path)
            with system.open_input_stream(place, compression="detect") as file:
                line = b""
                while b"\n" not in line and (more := file.read(1 << 16)):
                    line += more
            yield pd.DataFrame({"path": [path], "head": [line.split(b"\n", 1)[0].decode().rstrip("\r")]})

    files = spark.read.format("binaryFile").load(list(paths)).select("path")  # contents are not read here
    heads: dict[str, list[str]] = {}
    for path, head in sorted(map(tuple, files.mapInPandas(run, "path string, head string").collect())):  # a line for each file
        heads.setdefault(head.removeprefix("\ufeff"), []).append(path)
    frames = [read_text_csv(spark, group, sep, quote) for head, group in sorted(heads.items()) if head]
    if not frames:
        raise ValueError("no file has a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row `value` for each line, without a carriage return at its end."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"))


def slice_fixed_width(df: DataFrame, fields: Mapping[str, tuple[int, int]], col: str = "value", key: str | None = None) -> DataFrame:
    """Columns cut from places (start from 1, length) of a text and trimmed; rows with a blank key go."""
    out = df.select(*[F.trim(F.substring(col, a, n)).alias(name) for name, (a, n) in fields.items()])
    return out.filter(F.col(key) != "") if key else out


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that holds an array of objects, or one object, as rows; with source columns `path` and `file_name`."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"))


def explode_positional(df: DataFrame, fields: str, data: str, names: Sequence[str]) -> DataFrame:
    """Rows of columnar JSON: `data` holds arrays whose positions the names in `fields` give, whatever their order."""
    rows = df.select(F.col(fields).alias("_f"), F.explode(data).alias("_d"))
    return rows.select(*[F.try_element_at("_d", F.nullif(F.array_position("_f", n), F.lit(0).cast("bigint")).cast("int")).alias(n) for n in names])


def explode_positional_text(df: DataFrame, body: str, fields: str, data: str, names: Sequence[str]) -> DataFrame:
    """explode_positional of JSON texts {fields: […], data: [[…], …]}; texts that are no such JSON give no rows."""
    parsed = df.select(F.from_json(body, f"`{fields}` array<string>, `{data}` array<array<string>>").alias("_j"))
    return explode_positional(parsed.select(F.col(f"_j.`{fields}`").alias("_f0"), F.col(f"_j.`{data}`").alias("_d0")), "_f0", "_d0", names)


def flatten_jsonapi(pages: DataFrame, body: str, attributes: Sequence[str]) -> DataFrame:
    """Records of JSON:API pages: (id, type, attributes…); pages without data give no rows."""
    schema = f"struct<data:array<struct<id:string,type:string,attributes:struct<{','.join(f'`{a}`:string' for a in attributes)}>>>>"
    rows = pages.select(F.explode(F.from_json(body, schema)["data"]).alias("_d"))
    return rows.select(F.col("_d.id").alias("id"), F.col("_d.type").alias("type"), *[F.col("_d.attributes")[a].alias(a) for a in attributes])


def safe_member(name: Column) -> Column:
    """Whether an archive member's name stays inside: not absolute, no drive, no `..` part."""
    bad = name.rlike(r"\A[/\\]") | name.rlike(r"\A[A-Za-z]:") | name.rlike(r"(\A|[/\\])\.\.([/\\]|\z)")
    return F.coalesce(~bad & (name != ""), F.lit(False))


def file_system(path: str):
    """The file system of a path and the place in it: local, or any that Arrow knows by its scheme."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def read_archive_members(spark: SparkSession, path: str, members: Sequence[str] | None = None, pattern: str | None = None, most_bytes: int = 256 << 20) -> DataFrame:
    """Members of zip archives that are named or match the pattern anywhere: (archive, member, bytes, content, safe).

    Archives are opened by path in the tasks and read member by member, so their size has no limit; a
    wanted member that unpacks to more than most_bytes, or to more than it states, is an error.
    Directories are left out; the content of unsafe names is not read.
    """
    if not members and not pattern:
        raise ValueError("give members or a pattern")
    names, rx = set(members or ()), re.compile(pattern) if pattern else None
    unsafe = re.compile(r"\A[/\\]|\A[A-Za-z]:|(?:\A|[/\\])\.\.(?:[/\\]|\Z)")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for archive in (p for f in frames for p in f["path"]):
            system, place = file_system(archive)
            with system.open_input_file(place) as file, zipfile.ZipFile(file) as z:
                for info in z.infolist():
                    if info.is_dir() or not (info.filename in names or rx and rx.search(info.filename)):
                        continue
                    safe, content = not unsafe.search(info.filename), None
                    if safe:
                        with z.open(info) as member:
                            content = member.read(most_bytes + 1)
                        if len(content) > most_bytes:
                            raise ValueError(f"{info.filename} in {archive} has more than {most_bytes} bytes")
                    yield pd.DataFrame({"archive": [archive], "member": [info.filename], "bytes": [info.file_size], "content": [content], "safe": [safe]})

    files = spark.read.format("binaryFile").load(path).select("path")  # contents are not read here
    return files.mapInPandas(run, "archive string, member string, bytes long, content binary, safe boolean")


def url_origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, ORIGIN, 1), F.lit(""))


def url_dir_base(url: Column) -> Column:
    """The URL up to the last slash of its path, query and fragment left out."""
    origin = url_origin(url)
    path = F.regexp_extract(F.substr(url, F.length(origin) + 1), r"\A([^?#]*)", 1)
    return F.concat(origin, F.when(path.contains("/"), F.regexp_extract(path, r"\A(.*/)", 1)).otherwise("/"))


def absolutise(base: Column, href: Column) -> Column:
    """A link as an absolute URL; null for an empty one, a fragment, or a base that is none."""
    h = F.trim(href)
    scheme = F.nullif(F.regexp_extract(base, r"\A([^:]+)://", 1), F.lit(""))
    return (
        F.when((h == "") | h.startswith("#"), F.lit(None).cast("string"))
        .when(h.rlike(SCHEME), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(url_origin(base), h))
        .otherwise(F.concat(url_dir_base(base), h))
    )


def discover_links(pages: DataFrame, pattern: str = "", limit: int | None = None, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Links of each page whose raw href matches, absolute, once each: (page, link, rank) in document order, up to limit."""
    hrefs = pages.select(page, url, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("_pos", "_href"))
    kept = hrefs.filter(F.col("_href").rlike(pattern)) if pattern else hrefs
    links = kept.select(page, "_pos", absolutise(F.col(url), F.col("_href")).alias("link")).filter("link IS NOT NULL")
    first = links.groupBy(page, "link").agg(F.min("_pos").alias("_pos"))
    from pyspark.sql import Window

    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy("_pos"))).drop("_pos")
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def load_resources(spark: SparkSession, descriptor: Mapping, base: str) -> tuple[dict[str, DataFrame], list[str]]:
    """DataFrames of a descriptor's resources by name, and those left out for their format; an error where none loads."""
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
    out, skipped = {}, []
    for r in descriptor.get("resources", []):
        fmt, path = str(r.get("format", "")).lower() or str(r["path"]).rsplit(".", 1)[-1], r["path"] if ":" in r["path"].split("/")[0] or r["path"].startswith("/") else f"{base.rstrip('/')}/{r['path']}"
        if fmt == "parquet":
            df = spark.read.parquet(path)
        elif fmt in ("csv", "tsv"):
            df = read_text_csv(spark, path, "\t" if fmt == "tsv" else ",")
        elif fmt in ("json", "ndjson"):
            df = spark.read.option("multiLine", fmt == "json").json(path)
        else:
            skipped.append(r["name"])
            continue
        fields = r.get("schema", {}).get("fields", [])
        if fields and fmt != "parquet":
            df = df.select(*[F.col(f"`{f['name']}`").try_cast(kinds.get(f.get("type", "string"), "string")).alias(f["name"]) for f in fields])
        out[r["name"]] = df
    if not out:
        raise ValueError("no resource of the descriptor can be loaded")
    return out, skipped


def read_any(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The plain readers by name: parquet, csv, json (an object to a line), json_objects, text (whole files), blob."""
    readers = {
        "parquet": lambda: spark.read.parquet(path),
        "csv": lambda: read_text_csv(spark, path),
        "json": lambda: spark.read.json(path),
        "json_objects": lambda: spark.read.text(path).select(F.col("value").alias("json")),
        "text": lambda: spark.read.text(path, wholetext=True),
        "blob": lambda: spark.read.format("binaryFile").load(path),
    }
    if kind not in readers:
        raise ValueError(f"unknown reader {kind}; known: {', '.join(readers)}")
    return readers[kind]()


def _segment(glob: str) -> re.Pattern:
    """A path segment's glob as a pattern: * and ? within the segment, [abc], [a-z] and [!abc]."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1  # a class holds one character at least
        if end > 0:
            inner = glob[k + 1 : end]
            inner, sign = (inner[1:], "^") if inner[0] in "!^" else (inner, "")
            if inner:
                out += f"[{sign}" + re.sub(r"([\\\[\]^&|~])", r"\\\1", inner) + "]"
                k = end + 1
                continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return re.compile(out + r"\Z")


def glob_files(spark: SparkSession, glob: str) -> list[tuple[str, int, float]]:
    """(path, bytes, seconds of the last change) of the files that a glob names, by path.

    `*` and `?` stay within a path segment, `[a-c]` and `[!a-c]` are one character, `**` is any number of folders, none
    included, and, at the end, all files below. A folder is listed only if something below it can match. Names that
    begin with `_` or `.` match only segments that begin alike. Any scheme that Spark knows; a folder that is not there
    has no files.
    """
    parts = glob.split("/")
    fixed = next((k for k, s in enumerate(parts) if re.search(r"[*?\[]", s)), len(parts) - 1)
    root, rest = "/".join(parts[:fixed]) or "/", [s for s in parts[fixed:] if s]
    rules = [None if s == "**" else _segment(s) for s in rest]

    def closed(states: set[int]) -> set[int]:
        out = set(states)
        for k in sorted(states):
            while k < len(rules) and rules[k] is None:
                k += 1
                out.add(k)
        return out

    def moved(states: set[int], name: str) -> set[int]:
        out = set()
        for k in states:
            if k < len(rules) and (name[0] not in "_." or (rest[k][:1] == name[0])):
                if rules[k] is None:
                    out.add(k)
                elif rules[k].match(name):
                    out.add(k + 1)
        return closed(out)

    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[tuple[str, int, float]] = []
    folders = [(place, closed({0}))] if system.exists(place) else []
    while folders:
        folder, states = folders.pop()
        for f in system.listStatus(folder):
            name = f.getPath().getName()
            to = moved(states, name)
            if f.isDirectory():
                if any(k < len(rules) for k in to):
                    folders.append((f.getPath(), to))
            elif len(rules) in to:
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime() / 1000))
    return sorted(found)


def file_manifest(spark: SparkSession, root: str, pattern: str = "") -> DataFrame:
    """(path, name, bytes, mtime, sha256) of all files below a folder, or that a glob names (glob_files), whose path matches the pattern.

    Files are hashed piece by piece in the tasks.
    """
    rx = re.compile(pattern) if pattern else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = f[[rx is None or bool(rx.search(p)) for p in f["path"]]].copy()
            digests = []
            for path in kept["path"]:
                system, place = file_system(path)
                h = hashlib.sha256()
                with system.open_input_stream(place, compression=None) as file:
                    while data := file.read(8 << 20):
                        h.update(data)
                digests.append(h.hexdigest())
            kept["sha256"] = pd.Series(digests, index=kept.index, dtype="str")
            yield kept

    if re.search(r"[*?\[]", root):
        listed = spark.createDataFrame(glob_files(spark, root), "path string, length long, at double")
        files = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("modificationTime", F.timestamp_seconds("at"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)  # contents are not read here
    rows = files.select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    return rows.mapInPandas(run, "path string, name string, bytes long, mtime timestamp, sha256 string")


def row_groups(spark: SparkSession, root: str) -> DataFrame:
    """(path, row_group, n_rows, bytes) of the Parquet files below a folder, from their footers alone, read in the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for path in (p for f in frames for p in f["path"]):
            system, place = file_system(path)
            with system.open_input_file(place) as file:
                footer = pq.ParquetFile(file).metadata
            groups = [footer.row_group(k) for k in range(footer.num_row_groups)]
            size = [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups]
            yield pd.DataFrame({"path": path, "row_group": range(len(groups)), "n_rows": [g.num_rows for g in groups], "bytes": size})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")
    return files.mapInPandas(run, "path string, row_group int, n_rows long, bytes long")
