"""Gates, contracts, profiles, fingerprints, change detection and lineage on the test tables."""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import query
from tesserae.operators import fingerprint, gates, lineage, packages, profile, reshape
from tesserae.session import fresh_path, ship, table
from tesserae.streaming.streams import STATE_STORE, gated, latest_states, save_bursts
from tesserae.streaming.streams import debounced as debounced_log

_EXPECTED = {"customer": 1500, "supplier": 60, "part": 3000}


@query("gate_row_count", "WITH b(name, expected) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in _EXPECTED.items()) + "), a AS (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation) SELECT b.name, b.expected, a.n FROM a JOIN b ON a.name = b.name WHERE a.n < b.expected * 0.9 OR a.n > b.expected * 1.1")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    counts = None
    for n in (*_EXPECTED, "nation"):
        one = table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    return gates.row_count_delta(counts, spark.createDataFrame(list(_EXPECTED.items()), "name string, expected long"))


@query("gate_referential", "SELECT count(*) AS orphans FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) HAVING count(*) > 0")
def referential(spark: SparkSession, d: str) -> DataFrame:
    return gates.referential(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size > 25"), "l_partkey", "p_partkey")


_GOLDEN = [(0, "NATION_0", 0), (1, "NATION_1", 1), (2, "NATION_X", 2), (3, "NATION_3", None)]


@query("gate_golden", "WITH g(n_nationkey, n_name, n_regionkey) AS (VALUES (0, 'NATION_0', 0), (1, 'NATION_1', 1), (2, 'NATION_X', 2), (3, 'NATION_3', NULL)) SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = g.n_nationkey AND n.n_name = g.n_name AND n.n_regionkey IS NOT DISTINCT FROM g.n_regionkey)")
def golden(spark: SparkSession, d: str) -> DataFrame:
    return gates.golden_missing(table(spark, d, "nation"), spark.createDataFrame(_GOLDEN, "n_nationkey int, n_name string, n_regionkey int"))


_CONTRACT = {
    "properties": {
        "o_orderstatus": {"enum": ["F", "O"]},
        "o_orderpriority": {"pattern": "^[1-5]-[A-Z ]+$", "maxLength": 8},
        "o_orderkey": {"minLength": 3, "maximum": 10},
        "o_custkey": {"type": "string"},
        "price": {"pattern": r"^\$[1-9][0-9]*$"},
        "code": {"pattern": "^[^$]+[$][FO]$"},
        "large": {"enum": [True]},
        "one": {"const": 1},
    }
}
_CONTRACT_SQL = [
    ("o_orderstatus", "o_orderstatus", {"not in the list": "o_orderstatus NOT IN ('F', 'O')"}),
    ("o_orderpriority", "o_orderpriority", {"does not match": "NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')", "too long": "length(o_orderpriority) > 8"}),
    ("o_orderkey", "CAST(o_orderkey AS VARCHAR)", {"too short": "o_orderkey < 100"}),
    ("o_custkey", "CAST(o_custkey AS VARCHAR)", {}),
    ("price", "'$' || o_custkey % 7", {"does not match": "o_custkey % 7 = 0"}),
    ("code", "CASE WHEN o_custkey % 3 = 0 THEN '$' ELSE 'c' END || o_custkey || '$' || o_orderstatus", {"does not match": "o_custkey % 3 = 0 OR o_orderstatus = 'P'"}),
    ("large", "CASE WHEN o_custkey > 500 THEN 'true' ELSE 'false' END", {"not in the list": "NOT o_custkey > 500"}),
    ("one", "CAST(o_custkey % 2 AS VARCHAR)", {"not the constant": "o_custkey % 2 != 1"}),
]


@query(
    "gate_contract",
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS column_name, {v} AS v, CASE " + "".join(f"WHEN {c} THEN '{m}' " for m, c in bad.items()) + "WHEN FALSE THEN '' END AS m FROM orders" for n, v, bad in _CONTRACT_SQL)
    + ") SELECT column_name, count(v) AS total, count(m) AS rejects, min(v || ': ' || m) AS sample_message FROM r GROUP BY 1",
)
def contract(spark: SparkSession, d: str) -> DataFrame:
    """Rules of each kind: lists and constants that are no texts, dollar signs that are escaped, in classes, and the end."""
    k = F.col("o_custkey")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    orders = table(spark, d, "orders").withColumns(
        {
            "price": F.concat(F.lit("$"), text(k % 7)),
            "code": F.concat(F.when(k % 3 == 0, "$").otherwise("c"), text(k), F.lit("$"), "o_orderstatus"),
            "large": k > 500,
            "one": k % 2,
        }
    )
    return gates.validate_contract(orders, _CONTRACT)


@query("packaged_operator", "SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS total, 0 AS rejects FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (length(c_mktsegment) > 8) FROM customer")
def packaged(spark: SparkSession, d: str) -> DataFrame:
    """A contract check named by operator and version, with its options as data."""
    check = packages.operator("validate_contract@^1.1")
    out = check({"df": table(spark, d, "customer")}, {"contract": {"properties": {"c_mktsegment": {"maxLength": 8}, "c_acctbal": {"minimum": 0}}}})
    return out.select("column_name", "total", "rejects")


# what a contract derived from the parts of some sizes says of all parts: values that are not listed, or lengths beyond those seen
_DERIVED_SQL = "WITH seen AS (SELECT * FROM part WHERE p_size < 20 AND p_partkey % 7 = 1), " + ", ".join(
    f"r{k} AS (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, (SELECT count(DISTINCT {c}) FROM seen) <= 20 AS listed FROM part), "
    f"s{k} AS (SELECT column_name, count(v) AS total, count(*) FILTER (CASE WHEN listed THEN v NOT IN (SELECT CAST({c} AS VARCHAR) FROM seen) ELSE length(v) NOT BETWEEN (SELECT min(length(CAST({c} AS VARCHAR))) FROM seen) AND (SELECT max(length(CAST({c} AS VARCHAR))) FROM seen) END) AS rejects FROM r{k} GROUP BY 1)"
    for k, c in enumerate(("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
) + " " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(5))


@query("gate_derived_contract", _DERIVED_SQL)
def derived(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").drop("p_retailprice")
    return gates.validate_contract(part, gates.derive_contract(part.filter("p_size < 20 AND p_partkey % 7 = 1"))).select("column_name", "total", "rejects")


@query("gate_licence", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') THEN 'green' ELSE 'red' END AS licence_status FROM documents")
def licence(spark: SparkSession, d: str) -> DataFrame:
    return gates.licence_status(table(spark, d, "documents"), "source", "lang", ["src1", "src2", "src3"], ["en", "de"]).select("doc_id", "licence_status")


@query("gate_completeness", "SELECT count(*) AS received, count(*) * 2 AS advertised FROM orders")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return gates.completeness(orders, 2 * orders.count(), 200)


@query(
    "gate_case_collisions",
    """WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey < 40 AS made FROM part), s AS (SELECT lower(name) AS name, name AS s, max(CAST(made AS INTEGER)) AS p FROM n GROUP BY 1, 2)
SELECT name, count(*) AS spellings FROM s GROUP BY name HAVING count(*) > 1 AND sum(p) <> 1""",
)
def collisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), (k < 40).alias("made"))
    return gates.case_collisions(rows, "name", "made")


@query("gate_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return gates.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS largest, CAST(min(length(CAST({c} AS VARCHAR))) AS INTEGER) AS shortest, CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS longest FROM customer"
        for c in _PROFILED
    ),
)
def profiled(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "customer").select(*_PROFILED)).select("column_name", "n_values", "n_nulls", "least", "largest", "shortest", "longest")


@query("profile_top_values", "SELECT p_name AS value, count(*) AS n_rows FROM part GROUP BY 1 ORDER BY n_rows DESC, value LIMIT 10")
def top(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "part"), "p_name")


_SKETCHED = ("o_orderstatus", "o_orderpriority", "o_totalprice")


@query(
    "profile_sketch",
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2" for c in _SKETCHED[:2])
    + """), f AS (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS k FROM v)
SELECT column_name, 'frequent ' || k AS fact, value, n AS n_rows FROM f WHERE k <= 10 UNION ALL SELECT column_name, 'enum', string_agg(value, ',' ORDER BY value), sum(n)::BIGINT FROM v GROUP BY 1
UNION ALL SELECT 'o_totalprice', 'quantile', CAST(round(unnest(quantile_disc(o_totalprice, [0.25, 0.5, 0.75])) * 100) AS BIGINT)::VARCHAR, count(o_totalprice) FROM orders
UNION ALL SELECT 'o_totalprice', 'bounds', CAST(round(min(o_totalprice) * 100) AS BIGINT) || '-' || CAST(round(max(o_totalprice) * 100) AS BIGINT), count(o_totalprice) FROM orders""",
)
def sketched(spark: SparkSession, d: str) -> DataFrame:
    """Frequent values, bounds and lists of values from one pass, exact with so few values; exact quantiles from two more."""
    one = profile.sketch(table(spark, d, "orders").select(*_SKETCHED), exact=True)
    cents = lambda x: F.round(x * 100).cast("long").cast("string")
    c = F.col("constraints")
    frequent = one.filter("column_name != 'o_totalprice'").select("column_name", F.posexplode("frequent").alias("k", "f"))
    facts = [
        frequent.select("column_name", F.concat(F.lit("frequent "), (F.col("k") + 1).cast("string")).alias("fact"), "f.value", "f.n_rows"),
        one.filter(c["enum"].isNotNull()).select("column_name", F.lit("enum").alias("fact"), F.array_join(c["enum"], ",").alias("value"), F.col("n_values").alias("n_rows")),
        one.select("column_name", F.lit("quantile").alias("fact"), F.explode("quantiles").alias("q"), "n_values").select("column_name", "fact", cents(F.col("q")).alias("value"), F.col("n_values").alias("n_rows")),
        one.filter(c["minimum"].isNotNull()).select("column_name", F.lit("bounds").alias("fact"), F.concat_ws("-", cents(c["minimum"]), cents(c["maximum"])).alias("value"), F.col("n_values").alias("n_rows")),
    ]
    return reshape.union_by_name(*facts)


_SHARES = {"page_id": ("integer", "^[+-]?[0-9]+$"), "url": ("url", "^https?://[^ ]+$"), "html": ("boolean", "^(true|false)$")}


@query(
    "profile_semantic_types",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN avg(CAST(regexp_matches(CAST({c} AS VARCHAR), '{p}') AS INTEGER)) >= 0.95 THEN '{t}' ELSE 'text' END AS semantic_type FROM pages" for c, (t, p) in _SHARES.items()),
)
def semantic(spark: SparkSession, d: str) -> DataFrame:
    return profile.infer_semantic_types(table(spark, d, "pages")).select("column_name", "semantic_type")


@query(
    "profile_descriptor",
    """SELECT 'n_nationkey' AS name, 'integer' AS semantic_type, (SELECT count(*) = count(n_nationkey) FROM nation) AS required, NULL AS title, (SELECT sum(length(n_name) + 1) FROM nation) AS bytes, (SELECT 'sha256:' || sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) FROM nation) AS hash
UNION ALL SELECT 'n_name', 'text', (SELECT count(*) = count(n_name) FROM nation), 'Name', (SELECT sum(length(n_name) + 1) FROM nation), (SELECT 'sha256:' || sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) FROM nation)""",
)
def descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a descriptor, with a curated title, and the size and digest of the file beside it."""
    nation, path = table(spark, d, "nation"), fresh_path(spark, "described")
    nation.select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(path)
    out = json.loads(profile.describe(nation.select("n_nationkey", "n_name"), "nation", {"fields": {"n_name": {"title": "Name"}}, "primaryKey": ["n_nationkey"]}, path))["resources"][0]
    rows = [(f["name"], f["semantic_type"], f["constraints"]["required"], f.get("title"), out["bytes"], out["hash"]) for f in out["schema"]["fields"]]
    return spark.createDataFrame(rows, "name string, semantic_type string, required boolean, title string, bytes long, hash string")


# a digest tree over rows (k, h): leaves by the first 0, 2 or 4 digits of h, 256 nodes to one
_PRINT_SQL = """n AS (SELECT k, count(*) AS n_rows, CASE WHEN count(*) <= 4096 THEN 0 WHEN count(*) <= 4096 * 256 THEN 2 ELSE 4 END AS digits FROM h GROUP BY k),
c AS (SELECT k, h || ':' || count(*) AS e, h FROM h GROUP BY k, h),
l AS (SELECT k, n_rows, digits, substr(h, 1, digits) AS b, sha256(string_agg(e, ',' ORDER BY e)) AS d FROM c JOIN n USING (k) GROUP BY ALL),
u AS (SELECT k, n_rows, greatest(digits - 2, 0) AS digits, CASE WHEN digits = 0 THEN '' ELSE substr(b, 1, digits - 2) END AS b, CASE WHEN digits = 0 THEN max(d) ELSE sha256(string_agg(b || ':' || d, ',' ORDER BY b)) END AS d FROM l GROUP BY k, n_rows, digits, CASE WHEN digits = 0 THEN '' ELSE substr(b, 1, digits - 2) END),
p AS (SELECT k, n_rows, sha256(n_rows || ':' || CASE WHEN digits = 0 THEN max(d) ELSE sha256(string_agg(b || ':' || d, ',' ORDER BY b)) END) AS fingerprint FROM u GROUP BY k, n_rows, digits)"""


@query(
    "fp_table",
    f"""WITH h AS (SELECT 1 AS k, sha256('{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '","l_suppkey":' || l_suppkey || '}}') AS h FROM lineitem), {_PRINT_SQL} SELECT n_rows, fingerprint FROM p""",
)
def table_print(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.table_fingerprint(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"))


_TWO_SQL = """a AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 50 != 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 60 != 1 UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 70 = 3)"""


def two_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: rows removed, changed and repeated."""
    orders, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), F.col("o_orderkey")
    changed = orders.filter(k % 60 != 1).withColumn("o_orderstatus", F.when(k % 40 == 0, "X").otherwise(F.col("o_orderstatus")))
    return orders.filter(k % 50 != 1), changed.unionByName(orders.filter(k % 70 == 3))


@query(
    "fp_differing_buckets",
    f"""WITH {_TWO_SQL}, j AS (SELECT 1 AS t, * FROM a UNION ALL SELECT 2, * FROM b), h AS (SELECT t, sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM j),
c AS (SELECT t, h, count(*) AS c FROM h GROUP BY ALL), l AS (SELECT t, substr(h, 1, 4) AS bucket, sum(c)::BIGINT AS n, sha256(string_agg(h || ':' || c, ',' ORDER BY h)) AS d FROM c GROUP BY ALL)
SELECT coalesce(x.bucket, y.bucket) AS bucket, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM (SELECT * FROM l WHERE t = 1) x FULL JOIN (SELECT * FROM l WHERE t = 2) y ON x.bucket = y.bucket WHERE x.d IS DISTINCT FROM y.d""",
)
def differing(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.differing_buckets(*two_versions(spark, d), 4)


@query(
    "fp_differing_rows",
    f"""WITH {_TWO_SQL}, x AS (SELECT *, count(*) AS n_a FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n_b FROM b GROUP BY ALL)
SELECT o_orderkey, o_orderstatus, o_custkey, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM x FULL JOIN y USING (o_orderkey, o_orderstatus, o_custkey) WHERE n_a IS DISTINCT FROM n_b""",
)
def differing_rows(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.differing_rows(*two_versions(spark, d), 4)


@query(
    "fp_verified_content",
    """WITH r AS (SELECT doc_id AS locator, sha256(text) AS actual, CASE doc_id % 5 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN substr(sha256(text), 2) ELSE sha256(text || 'x') END AS declared FROM documents),
j AS (SELECT *, CASE WHEN coalesce(trim(declared), '') = '' THEN 'blank' WHEN length(declared) < 64 THEN 'malformed' WHEN lower(declared) != actual THEN 'mismatch' END AS reason FROM r)
SELECT locator, actual AS sha256, coalesce(reason, 'kept ' || count(*) FILTER (reason IS NULL) OVER (PARTITION BY actual)) AS verdict FROM j""",
)
def verified(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each declared digest: kept, with the number of kept locators of that content, or why it is refused."""
    k, digest = F.col("doc_id") % 5, F.sha2("text", 256)
    said = F.when(k == 0, F.upper(digest)).when(k == 1, " ").when(k == 3, F.substring(digest, 2, 63)).when(k == 4, F.sha2(F.concat("text", F.lit("x")), 256))
    objects, locators, refused = fingerprint.verified_content(table(spark, d, "documents").withColumn("declared", said), "doc_id", "text", "declared")
    kept = locators.join(objects, "sha256").select("locator", "sha256", F.concat(F.lit("kept "), F.col("n_locators").cast("string")).alias("verdict"))
    return kept.unionByName(refused.select("locator", "sha256", F.col("reason").alias("verdict")))


@query(
    "fp_dataset",
    f"""WITH f AS (SELECT 'orders/' || o_orderkey AS path, sha256(o_orderstatus) AS sha256, o_orderkey = (SELECT min(o_orderkey) FROM orders) AS first FROM orders),
v AS (SELECT 'as it is' AS version, path, sha256 FROM f UNION ALL SELECT 'renamed', CASE WHEN first THEN 'new' ELSE path END, sha256 FROM f UNION ALL SELECT 'changed', path, CASE WHEN first THEN sha256('new') ELSE sha256 END FROM f),
h AS (SELECT version AS k, sha256('{{"path":"' || path || '","sha256":"' || sha256 || '"}}') AS h FROM v), {_PRINT_SQL} SELECT k AS version, fingerprint FROM p""",
)
def dataset_print(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    first = F.col("o_orderkey") == F.col("k")
    rows = orders.crossJoin(F.broadcast(orders.agg(F.min("o_orderkey").alias("k"))))  # one row
    files = rows.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.sha2("o_orderstatus", 256).alias("sha256"), first.alias("first"))
    versions = {
        "as it is": files,
        "renamed": files.withColumn("path", F.when(F.col("first"), "new").otherwise(F.col("path"))),
        "changed": files.withColumn("sha256", F.when(F.col("first"), F.sha2(F.lit("new"), 256)).otherwise(F.col("sha256"))),
    }
    out = [fingerprint.dataset_fingerprint(v).select(F.lit(n).alias("version"), "fingerprint") for n, v in versions.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("gate_count_agreement", "SELECT count(*) AS n_a, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS n_b FROM orders HAVING count(*) <> (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return gates.count_agreement(orders, orders.filter("o_orderstatus <> 'P'"))


@query(
    "fp_snapshot_diff",
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0), c AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM c FULL JOIN p ON c.o_orderkey = p.o_orderkey WHERE p.o_orderkey IS NULL OR c.o_orderkey IS NULL OR c.s <> p.s""",
)
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows, k = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), F.col("o_orderkey")
    prior = rows.filter(k % 7 != 0).withColumn("s", F.when(k % 10 == 3, "X").otherwise(F.col("s")))
    return fingerprint.snapshot_diff(rows.filter(k % 11 != 0), prior, ["o_orderkey"])


@query(
    "fp_changed_files",
    """WITH c AS (SELECT 'f' || o_orderkey AS path, o_custkey AS bytes, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE sha256(o_orderstatus) END AS sha256 FROM orders WHERE o_orderkey % 7 <> 0), p AS (SELECT 'f' || o_orderkey AS path, o_custkey + CAST(o_orderkey % 9 = 0 AS INTEGER) AS bytes, sha256(o_orderstatus) AS sha256 FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN coalesce(c.sha256 = p.sha256 AND c.bytes = p.bytes, FALSE) THEN 'same' ELSE 'modified' END AS change FROM c FULL JOIN p ON c.path = p.path""",
)
def changed(spark: SparkSession, d: str) -> DataFrame:
    rows, k = table(spark, d, "orders"), F.col("o_orderkey")
    path, sha = F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2("o_orderstatus", 256)
    now = rows.filter(k % 7 != 0).select(path, F.col("o_custkey").alias("bytes"), F.when(k % 13 != 0, sha).alias("sha256"))
    then = rows.filter(k % 5 != 0).select(path, (F.col("o_custkey") + (k % 9 == 0).cast("int")).alias("bytes"), sha.alias("sha256"))
    return fingerprint.changed_files(now, then)


@query("fp_content_addressed", "SELECT sha256(text) AS sha256, min(octet_length(encode(text))) AS bytes, count(*) AS n_locators FROM documents GROUP BY 1")
def addressed(spark: SparkSession, d: str) -> DataFrame:
    objects, _ = fingerprint.content_addressed(table(spark, d, "documents"), "doc_id", "text")
    return objects.withColumn("bytes", F.col("bytes").cast("long"))


_LOG_SQL = "log AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'error' THEN 'checkpoint' ELSE 'save' END AS kind FROM events)"


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "error", "checkpoint").otherwise("save").alias("kind"))


@query(
    "fp_debounce",
    f"""WITH {_LOG_SQL}, a AS (SELECT *, lag(event_type) OVER w AS ps, row_number() OVER w AS rn FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT * FROM a WHERE rn = 1 OR event_type IS DISTINCT FROM ps),
c AS (SELECT *, lag(kind) OVER w AS pk, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN kind = 'save' AND pk = 'save' AND gap <= 36000000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts DESC, event_id DESC) AS k FROM r) WHERE k = 1""",
)
def debounced(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.debounce(log(spark, d), "user_id", "ts", "event_type", "kind", gap_seconds=36_000, tie="event_id").select("user_id", "event_id", "kind")


@query(
    "lineage_read_before_produce",
    """WITH s AS (SELECT l_orderkey AS step_no, 'o' || l_orderkey AS step, list(DISTINCT 'p' || l_partkey) AS reads, list(DISTINCT 's' || l_suppkey) || list(DISTINCT 'p' || (l_partkey + l_orderkey % 5)) AS produces FROM lineitem GROUP BY l_orderkey),
m AS (SELECT DISTINCT step_no, step, unnest(produces) AS asset FROM s), f AS (SELECT asset, min(step_no) AS producer_no FROM m GROUP BY asset), r AS (SELECT DISTINCT step_no, step, unnest(reads) AS asset FROM s)
SELECT r.step, r.asset, f.producer_no FROM r JOIN f ON r.asset = f.asset WHERE f.producer_no > r.step_no AND NOT EXISTS (SELECT 1 FROM m WHERE m.asset = r.asset AND m.step = r.step)""",
)
def early_reads(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x: F.concat(F.lit("p"), x.cast("string"))
    li = table(spark, d, "lineitem")
    steps = li.groupBy(F.col("l_orderkey").alias("step_no")).agg(
        F.collect_set(p(F.col("l_partkey"))).alias("reads"),
        F.concat(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))), F.collect_set(p(F.col("l_partkey") + F.col("l_orderkey") % 5))).alias("produces"),
    )
    return lineage.read_before_produce(steps.withColumn("step", F.concat(F.lit("o"), F.col("step_no").cast("string"))))


_GRAPH_SQL = "e AS (SELECT DISTINCT l_suppkey AS parent, 1000000 + l_partkey AS child FROM lineitem WHERE l_discount > 0.08 UNION SELECT 1000000 + p_partkey, 1000000 + p_partkey * 2 FROM part UNION SELECT 1000000 + p_partkey * 3, 1000000 + p_partkey FROM part WHERE p_partkey % 50 = 1)"


@query(
    "lineage_downstream",
    f"WITH RECURSIVE {_GRAPH_SQL}, seeds AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 9000), r AS (SELECT child AS node FROM e JOIN seeds ON parent = node UNION SELECT child FROM e JOIN r ON parent = node) SELECT node FROM r WHERE node NOT IN (SELECT node FROM seeds)",
)
def closure(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    part = table(spark, d, "part")
    edges = table(spark, d, "lineitem").filter("l_discount > 0.08").select(F.col("l_suppkey").alias("parent"), (F.col("l_partkey") + 1000000).alias("child"))
    edges = edges.union(part.select(p + 1000000, p * 2 + 1000000)).union(part.filter(p % 50 == 1).select(p * 3 + 1000000, p + 1000000))
    seeds = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))
    return lineage.downstream(edges, seeds)


_SECRET = '"***REDACTED***"'


@query(
    "lineage_redact",
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"api_key":{_SECRET},"k":' || k || '}}' WHEN 1 THEN '{{"k": ' || k || ', "userToken": {_SECRET}}}' WHEN 2 THEN '{{"password": {_SECRET}, "l":[{{"k":' || k || ', "Auth" : {_SECRET}}}, "token"]}}'
WHEN 3 THEN '{{"a":{{"b":[{{"p\\u0061sswd":{_SECRET}}}]}},"k":' || k || '}}' END AS props FROM (SELECT event_id, event_id % 7 AS k FROM events)""",
)
def redacted(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    k, user = (F.col("event_id") % 7).cast("string"), F.col("user_id").cast("string")
    forms = [
        ('{"api_key":"x', user, '","k":', k, "}"),
        ('{"k": ', k, ', "userToken": ', user, "}"),
        ('{"password": {"a":{"b":[1,"', user, '"]}}, "l":[{"k":', k, ', "Auth" : [["', user, '"]]}, "token"]}'),
        ('{"a":{"b":[{"p\\u0061sswd":"\\"', user, '}"}]},"k":', k, "}"),
        ("no JSON: token=", user),
    ]
    props = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        props = F.when(F.col("event_id") % 5 == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form])).otherwise(props)
    return table(spark, d, "events").select("event_id", lineage.redact_json(props).alias("props"))


# a run for each user, with a step for each kind of event
_RUNS_SQL = """s AS (SELECT 'u' || user_id AS run_id, event_type AS step, count(*) AS n, min(ts) AS a, max(ts) AS z, min(event_id) AS i, max(event_id) AS j FROM events GROUP BY 1, 2)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    asset = lambda c: F.array(F.concat(F.lit("e"), c.cast("string")))
    steps = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.min("event_id").alias("i"), F.max("event_id").alias("j"))
    skipped = F.col("n") == 1
    step = F.struct(
        "step",
        F.when(skipped, "skipped").otherwise("done").alias("state"),
        F.col("n").cast("int").alias("attempts"),
        F.when(~skipped, F.col("a")).alias("started"),
        F.when(~skipped, F.col("z")).alias("ended"),
        F.when(skipped, "unchanged").alias("skip_reason"),
        asset(F.col("i")).alias("consumed"),
        asset(F.col("j")).alias("produced"),
    )
    return steps.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id")).agg(F.collect_list(step).alias("steps"))


@query("lineage_run_history", f"WITH {_RUNS_SQL} SELECT run_id, step, CASE WHEN n = 1 THEN 'skipped' ELSE 'done' END AS state, n AS attempts, CASE WHEN n = 1 THEN 'unchanged' END AS skip_reason, CASE WHEN n > 1 THEN round((epoch_us(z) - epoch_us(a)) / 1e6, 3) END AS seconds FROM s")
def history(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.run_history(runs(spark, d))
    return out.select("run_id", "step", "state", F.col("attempts").cast("long").alias("attempts"), "skip_reason", F.round("seconds", 3).alias("seconds"))


@query("lineage_run_edges", f"WITH {_RUNS_SQL} SELECT run_id, step, 'e' || i AS asset, 'consumed' AS direction FROM s WHERE n > 1 UNION ALL SELECT run_id, step, 'e' || j, 'produced' FROM s WHERE n > 1")
def run_edges(spark: SparkSession, d: str) -> DataFrame:
    return lineage.run_edges(lineage.run_history(runs(spark, d)))


@query("stream_latest_state", "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_states(table(spark, d, "events"), ["user_id"], "event_type", "ts", "event_id")


@query(
    "stream_save_bursts",
    f"""WITH {_LOG_SQL}, s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 7200000000 THEN 0 ELSE 1 END AS b FROM log WHERE kind = 'save' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT user_id, min(ts) AS started, max(ts) AS ts, arg_max(event_type, ts) AS event_type, count(*) AS n_saves FROM r GROUP BY user_id, run""",
)
def bursts(spark: SparkSession, d: str) -> DataFrame:
    return save_bursts(log(spark, d).filter("kind = 'save'"), "user_id", "ts", "event_type", gap="2 hours")


@query(
    "stream_debounce",
    f"""WITH {_LOG_SQL}, a AS (SELECT *, lag(event_type) OVER w AS ps, row_number() OVER w AS rn FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT * FROM a WHERE rn = 1 OR event_type IS DISTINCT FROM ps),
c AS (SELECT *, lag(kind) OVER w AS pk, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN kind = 'save' AND pk = 'save' AND gap <= 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, event_id, kind, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts DESC, event_id DESC) AS k FROM r) WHERE k = 1""",
)
def debounced_stream(spark: SparkSession, d: str) -> DataFrame:
    """The whole log as a stream, with a last row far ahead, so that the watermark passes all others."""
    ship(spark)
    rows = log(spark, d)
    closing = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), F.lit("save").alias("kind"))
    source, out, state = (fresh_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    rows.unionByName(closing).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        judged = debounced_log(stream, "user_id", "ts", "event_type", "kind", "event_id", gap_seconds=7_200)
        judged.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(judged.schema).parquet(out).filter("user_id != -1").select("user_id", "event_id", "kind", "event_type")


@query(
    "stream_gated",
    "SELECT 'accepted' AS verdict, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 2 UNION ALL SELECT 'refused', o_orderstatus, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 2 HAVING count(*) > 0",
)
def gated_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a stream through a gate that finds nothing, and through one whose finding ends the stream before anything is stored; then what each has stored or refused."""
    source = fresh_path(spark, "orders")
    table(spark, d, "orders").write.parquet(source)
    stream = spark.readStream.schema(table(spark, d, "orders").schema).parquet(source)
    out, none = fresh_path(spark, "accepted"), fresh_path(spark, "refused")

    def through(gate, into: str) -> bool:
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{into}/batch={number}")
        run = gated(stream, gate, "orders", sink).option("checkpointLocation", fresh_path(spark, "gated")).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except StreamingQueryException as e:
            if "orders" not in str(e):
                raise
            return False
        return True

    accepted = through(lambda rows: gates.duplicate_keys(rows, ["o_orderkey"]), out)
    closed = through(lambda rows: rows.filter("o_orderstatus = 'P'").groupBy("o_orderstatus").count(), none)
    stored = spark.read.parquet(f"{out}/batch=*").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = stored.filter(F.lit(accepted)).select(F.lit("accepted").alias("verdict"), "o_orderstatus", "n_rows")
    refused = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))
    return kept.unionByName(refused.filter(F.lit(not closed)).select(F.lit("refused").alias("verdict"), "o_orderstatus", "n_rows"))
