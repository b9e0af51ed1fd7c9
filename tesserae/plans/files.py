"""Sources and sinks: what is written from the test tables is read back by the library's readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import query
from tesserae.operators import reshape
from tesserae.operators.crosswalk import split_trailing_token
from tesserae.operators.fingerprint import valid_digest
from tesserae.session import fresh_path, ship, table
from tesserae.sources import readers, sinks


@query("src_parquet", "SELECT * FROM supplier")
def parquet(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_parquet(spark, f"{d}/supplier.parquet")


@query("src_text_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS label FROM customer")
def text_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("label"))
    path = fresh_path(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_text_csv(spark, path)


@query("src_delimited_by_name", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 'r' FROM region")
def by_name(spark: SparkSession, d: str) -> DataFrame:
    a, b = fresh_path(spark, "tsv"), fresh_path(spark, "tsv")
    write = lambda df, p: df.coalesce(1).write.option("header", True).option("sep", "\t").csv(p)
    write(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), a)
    write(table(spark, d, "region").select(F.lit("r").alias("extra"), F.col("r_name").alias("v"), F.col("r_regionkey").alias("k")), b)
    return readers.read_delimited_by_name(spark, [a, b]).select("k", "v", "extra")


@query("src_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def lines(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "text")
    table(spark, d, "documents").select("text").write.option("lineSep", "\r\n").text(path)
    return readers.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("src_fixed_width", "SELECT trim(substr(c_name, 1, 8)) AS kind, trim(substr(c_name, 10, 9)) AS number, trim(substr(rpad(c_mktsegment, 12, ' '), 1, 12)) AS segment FROM customer")
def fixed_width(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat("c_name", F.rpad("c_mktsegment", 12, " ")).alias("value"))
    return readers.slice_fixed_width(rows, {"kind": (1, 8), "number": (10, 9), "segment": (19, 12)}, key="number")


@query("src_trailing_token", "SELECT c_custkey, trim(regexp_replace(c_name, '#[0-9]+$', '')) AS name, regexp_extract(c_name, '#([0-9]+)$', 1) AS token FROM customer WHERE regexp_matches(c_name, '#[0-9]+$')")
def trailing(spark: SparkSession, d: str) -> DataFrame:
    return split_trailing_token(table(spark, d, "customer"), "c_name", "#([0-9]+)").select("c_custkey", "name", "token")


@query("src_json_array", "SELECT n_nationkey, n_name, TRUE AS named FROM nation")
def json_array(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "json")
    one = table(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.write.text(path)
    return readers.read_json_array(spark, path, "n_nationkey int, n_name string").select("n_nationkey", "n_name", F.col("file_name").startswith("part-").alias("named"))


@query("src_columnar_json", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(NULL AS VARCHAR) AS none FROM supplier")
def columnar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.array("s_name", F.col("s_suppkey").cast("string"))).alias("data"))
    return readers.explode_positional(rows.withColumn("fields", F.array(F.lit("name"), F.lit("id"))), "fields", "data", ["id", "name", "none"])


@query("src_jsonapi", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'order' AS type, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS missing FROM orders")
def jsonapi(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("order").alias("type"), F.struct(F.col("o_orderstatus").alias("status")).alias("attributes"))
    pages = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("body"))
    empty = pages.limit(1).select("o_custkey", F.lit('{"data": []}').alias("body"))
    return readers.flatten_jsonapi(pages.union(empty), "body", ["status", "missing"])


@query("src_archive_members", "SELECT 'n' || n_nationkey || '.tsv' AS member, CAST(length(n_name) AS BIGINT) AS bytes, n_name AS text, TRUE AS safe FROM nation UNION ALL SELECT '../n' || n_nationkey || '.tsv', length(n_name), NULL, FALSE FROM nation WHERE n_nationkey = 0")
def archives(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    path = fresh_path(spark, "zips")

    def zipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tesserae.sources.sinks import save_bytes

        for f in frames:
            for k, name in zip(f["n_nationkey"], f["n_name"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"n{k}.tsv", name)
                    z.writestr("skip.csv", "x")
                    if k == 0:
                        z.writestr(f"../n{k}.tsv", name)
                save_bytes(f"{path}/{k}.zip", out.getvalue())
                yield pd.DataFrame({"n": [1]})

    table(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(zipped, "n int").count()
    found = readers.read_archive_members(spark, f"{path}/*.zip", pattern=r"\.tsv$")
    return found.select("member", "bytes", F.col("content").cast("string").alias("text"), "safe")


_NAMES = ["'a/' || o_orderkey", "'/a/' || o_orderkey", "'C:' || o_orderkey", "'x/../' || o_orderkey", "'x..y/' || o_orderkey", "'..'"]
_NAME_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(_NAMES)) + " END"


@query("src_safe_member", rf"SELECT o_orderkey, NOT (regexp_matches(n, '^[/\\]') OR regexp_matches(n, '^[A-Za-z]:') OR regexp_matches(n, '(^|[/\\])\.\.([/\\]|$)')) AS safe FROM (SELECT o_orderkey, {_NAME_SQL} AS n FROM orders)")
def safe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", readers.safe_member(F.expr(_NAME_SQL)).alias("safe"))


_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]+)', 1)"
_ABS = f"""CASE WHEN h = '' OR h LIKE '#%' THEN NULL WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN regexp_extract(url, '^([^:]+)://', 1) || ':' || h WHEN h LIKE '/%' THEN {_ORIGIN} || h
ELSE {_ORIGIN} || CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*/)', 1) ELSE '/' END || h END"""
_LINKS_SQL = f"""WITH raw AS (SELECT page_id, url, regexp_extract(substr(url, length({_ORIGIN}) + 1), '^([^?#]*)', 1) AS p, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
one AS (SELECT page_id, url, p, unnest(hs) AS raw_h, generate_subscripts(hs, 1) AS pos FROM raw),
a AS (SELECT page_id, pos, raw_h, {_ABS} AS link FROM (SELECT *, trim(raw_h) AS h FROM one))"""


@query("src_links", _LINKS_SQL + " SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS rank FROM a WHERE link IS NOT NULL GROUP BY page_id, link")
def links(spark: SparkSession, d: str) -> DataFrame:
    return readers.discover_links(table(spark, d, "pages")).withColumn("rank", F.col("rank").cast("long"))


@query("src_links_matching", _LINKS_SQL + " SELECT page_id, link, rank FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS rank FROM a WHERE link IS NOT NULL AND regexp_matches(raw_h, '[aeiou]\\.?$') GROUP BY page_id, link) WHERE rank <= 2")
def matching(spark: SparkSession, d: str) -> DataFrame:
    return readers.discover_links(table(spark, d, "pages"), r"[aeiou]\.?\z", limit=2).withColumn("rank", F.col("rank").cast("long"))


_FIELDS = [{"name": "c_custkey", "type": "integer"}, {"name": "c_acctbal", "type": "number"}, {"name": "c_mktsegment", "type": "string"}]


@query(
    "src_resources",
    "SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n, 'int' AS kind, (SELECT sum(n_nationkey) FROM nation) AS total UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', (SELECT count(*) FROM customer), '{k}', (SELECT sum(c_custkey) FROM customer)" for f, k in (("csv", "bigint"), ("tsv", "bigint"), ("ndjson", "bigint"), ("json", "bigint"))),
)
def resources(spark: SparkSession, d: str) -> DataFrame:
    """Resources of each format by descriptor, with declared types; a format that is not known is left out."""
    rows, at = table(spark, d, "customer").select(*[f["name"] for f in _FIELDS]), {f: fresh_path(spark, f) for f in ("csv", "tsv", "ndjson", "json")}
    rows.write.option("header", True).csv(at["csv"])
    rows.write.option("header", True).option("sep", "\t").csv(at["tsv"])
    rows.write.json(at["ndjson"])
    sinks.write_json_arrays(rows, at["json"])
    listed = [{"name": "nation", "path": f"{d}/nation.parquet", "format": "parquet"}, {"name": "sheet", "path": "x.xlsx"}] + [{"name": f, "path": p, "format": f, "schema": {"fields": _FIELDS}} for f, p in at.items()]
    found, _ = readers.load_resources(spark, {"resources": listed}, "")
    out = []
    for name, df in found.items():
        key = df.columns[0]
        out.append(df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("total")).select(F.lit(name).alias("name"), "n", F.lit(dict(df.dtypes)[key]).alias("kind"), "total"))
    return reshape.union_by_name(*out)


@query("src_readers", "SELECT 'json' AS reader, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'json_objects', (SELECT count(*) FROM customer) UNION ALL SELECT 'text', (SELECT count(DISTINCT c_nationkey) FROM customer) UNION ALL SELECT 'blob', (SELECT count(DISTINCT c_nationkey) FROM customer)")
def any_reader(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each plain reader finds in a file for each nation."""
    path = fresh_path(spark, "ndjson")
    table(spark, d, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)  # a file for each nation
    counts = [readers.read_any(spark, k, f"{path}/*").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("reader"), "n") for k in ("json", "json_objects", "text", "blob")]
    return reshape.union_by_name(*counts)


_LINES_SQL = "SELECT {0} AS r, sum(length(n_name) + 1) AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation GROUP BY ALL"


@query("src_manifest", f"SELECT 'r=' || r AS folder, bytes, sha256 FROM ({_LINES_SQL.format('n_regionkey')})")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and digests of a file of names for each region."""
    ship(spark)
    path = fresh_path(spark, "parts")
    rows = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("n_name", F.col("n_regionkey").alias("r"))
    rows.write.partitionBy("r").text(path)
    found = readers.file_manifest(spark, path, r"\.txt\Z").filter(valid_digest(F.col("sha256")))
    return found.select(F.regexp_extract("path", "/(r=[0-9]+)/", 1).alias("folder"), "bytes", "sha256")


@query("src_columnar_json_text", "SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS none FROM supplier")
def columnar_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.array("s_name", F.col("s_suppkey").cast("string"))).alias("data"))
    body = F.to_json(F.struct(F.array(F.lit("name"), F.lit("id")).alias("fields"), "data")).alias("body")
    texts = rows.select(body).union(rows.limit(1).select(F.lit("no JSON")))
    return readers.explode_positional_text(texts, "body", "fields", "data", ["id", "name", "none"])


@query("sink_metadata", "SELECT 'n_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'least', min(n_name) FROM nation")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Key/value metadata that an export's footer carries, read back."""
    nation, path = table(spark, d, "nation"), fresh_path(spark, "export")
    facts = nation.agg(F.count(F.lit(1)).cast("string").alias("n_rows"), F.min("n_name").alias("least")).first().asDict()
    sinks.export_parquet(nation, path, ["n_nationkey"], metadata=facts)
    kept = spark.read.parquet(path).schema["n_nationkey"].metadata
    return spark.createDataFrame(sorted(kept.items()), "key string, value string")


@query(
    "sink_table_lifecycle",
    "SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) AS nations FROM region UNION ALL SELECT r_regionkey + 100, upper(r_name), 0 FROM region",
)
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A table made from a query, rows inserted by name, and a view joined with it."""
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.create_table(spark, "tesserae_regions", region, fresh_path(spark, "regions"))
    more = region.select(F.upper("r_name").alias("r_name"), (F.col("r_regionkey") + 100).cast(region.schema["r_regionkey"].dataType).alias("r_regionkey"))
    both = sinks.insert_rows(spark, "tesserae_regions", more)
    even = sinks.define_view("tesserae_even_nations", table(spark, d, "nation").filter("n_nationkey % 2 = 0"))
    return both.join(even, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("nations"))


@query("sink_export_parquet", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def export(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "export")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    sinks.export_parquet(rows, path, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], block_bytes=8 << 20, metadata={"b": "2", "a": "1"})
    return spark.read.parquet(path)


@query("sink_csv_lines", """SELECT n_nationkey || ',"' || replace(n_name, '_', '"' || '"') || '",' || CASE WHEN n_regionkey > 2 THEN '' ELSE '"r' || n_regionkey || '"' END AS line FROM nation""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    rows = table(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit('"')).alias("n"), F.when(F.col("n_regionkey") <= 2, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("r"))
    sinks.write_csv_lines(rows, path, ["n_nationkey"])
    return readers.read_lines(spark, path).select(F.col("value").alias("line"))


@query("sink_partitioned", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "partitioned")
    sinks.write_partitioned(table(spark, d, "orders"), path, ["o_orderstatus"], max_rows=5_000)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("sink_register", "SELECT count(*) AS n FROM part")
def registered(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "frozen")
    table(spark, d, "part").write.parquet(path)
    return sinks.register_files(spark, "tesserae_part", path).agg(F.count(F.lit(1)).alias("n"))


@query("sink_receipt", f"SELECT bytes, sha256, DATE '2025-01-01' AS as_of, 'pub/' || sha256 AS key FROM ({_LINES_SQL.format(0)})")
def receipt(spark: SparkSession, d: str) -> DataFrame:
    """What a folder with one file of names holds."""
    ship(spark)
    path = fresh_path(spark, "published")
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return sinks.receipt(spark, path, "2025-01-01", "pub/").filter(F.col("name").endswith(".txt")).select("bytes", "sha256", "as_of", "key")


@query("sink_row_groups", "SELECT c_nationkey, CAST(g AS INTEGER) AS row_group, least(16, n - 16 * g) AS n_rows FROM (SELECT c_nationkey, count(*) AS n, unnest(range(0, (count(*) + 15) // 16)) AS g FROM customer GROUP BY c_nationkey)")
def row_groups(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each row group of a file for each nation, at most 16, as the footers have them."""
    ship(spark)
    path = fresh_path(spark, "groups")
    sinks.write_partitioned(table(spark, d, "customer").repartition("c_nationkey"), path, ["c_nationkey"], row_group_rows=16)
    return readers.row_groups(spark, path).select(F.regexp_extract("path", "/c_nationkey=([0-9]+)/", 1).cast("int").alias("c_nationkey"), "row_group", "n_rows")


@query("sink_sized", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, TRUE AS within, TRUE AS as_planned FROM orders GROUP BY 1")
def sized(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status in files of a target size: what is read back, whether files have half to one and a half times it, and the planned number."""
    ship(spark)
    path, target = fresh_path(spark, "sized"), 24_000
    orders = table(spark, d, "orders")
    plan = sinks.write_sized(orders, path, target, ["o_orderstatus"], ["o_orderkey"])
    status = F.regexp_extract("path", "/o_orderstatus=([^/]+)/", 1).alias("o_orderstatus")
    files = readers.row_groups(spark, path).groupBy(status, "path").agg(F.sum("bytes").alias("bytes")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("made"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    rows = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    within = (F.col("most") <= 1.5 * target) & ((F.col("least") >= 0.5 * target) | (F.col("made") == 1))
    return rows.join(files, "o_orderstatus").join(plan, "o_orderstatus").select("o_orderstatus", "n", "keys", within.alias("within"), (F.col("made") == F.col("n_files")).alias("as_planned"))


@query("src_glob", f"SELECT 'r=' || r AS folder, bytes, sha256 FROM ({_LINES_SQL.format('n_regionkey')}) WHERE r BETWEEN 1 AND 3")
def glob(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and digests of the files that a glob finds below nested folders."""
    ship(spark)
    path = fresh_path(spark, "nested")
    rows = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").select("n_name", (F.col("n_regionkey") % 2).alias("p"), F.col("n_regionkey").alias("r"))
    rows.write.partitionBy("p", "r").text(path)
    found = readers.file_manifest(spark, f"{path}/**/r=[1-3]/*.t?t")
    return found.select(F.regexp_extract("path", "/(r=[0-9]+)/", 1).alias("folder"), "bytes", "sha256")
