"""Projections, predicates, joins, aggregates, windows and set operations on the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import query
from tesserae.functions import exprs, scalars
from tesserae.functions.sql import define_functions, set_variables
from tesserae.operators import joins, reshape, windows
from tesserae.operators.fixpoint import fixpoint
from tesserae.session import table


@query("scan_rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def rename(spark: SparkSession, d: str) -> DataFrame:
    return exprs.rename_map(table(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"})


@query("expr_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'partial' END AS state, CASE WHEN o_totalprice >= 300000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS tier FROM orders")
def case(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(s == "F", "done").when(s == "O", "open").otherwise("partial").alias("state"), F.when(p >= 300000, 2).when(p >= 100000, 1).otherwise(0).alias("tier"))


@query("expr_alias_reuse", "SELECT l_orderkey, l_linenumber, net, net * (1 + l_tax) AS gross FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)")
def alias_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.select("l_orderkey", "l_linenumber", "net", (F.col("net") * (1 + F.col("l_tax"))).alias("gross"))


@query("expr_coalesce_cast", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(round(value, 2), 0) AS value FROM events")
def coalesce_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.coalesce(F.round("value", 2), F.lit(0.0)).alias("value"),
    )


@query("expr_unpad", "SELECT c_custkey, CAST(CAST(split_part(c_name, '#', 2) AS BIGINT) AS VARCHAR) AS number FROM customer")
def unpad(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalars.unpad(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("number"))


@query("expr_predicates", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus BETWEEN 'F' AND 'O' AND o_orderstatus <> 'P' AND o_custkey IS NOT NULL AND o_orderpriority <> ''")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, d, "orders").filter(p.isin("1-URGENT", "2-HIGH") & s.between("F", "O") & (s != "P") & F.col("o_custkey").isNotNull() & (p != "")).select("o_orderkey")


@query("expr_like_regex", "SELECT p_partkey, p_name LIKE 'small%' AS is_small, regexp_full_match(p_name, '[a-z]+ [a-z]+') AS plain, regexp_matches(p_name, 'bolt') AS bolt FROM part")
def like_regex(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", n.like("small%").alias("is_small"), exprs.full_match(n, "[a-z]+ [a-z]+").alias("plain"), n.rlike("bolt").alias("bolt"))


@query("expr_null_safe", "SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') IS DISTINCT FROM 'HOUSEHOLD' AS other, nullif(c_mktsegment, 'FURNITURE') IS NOT DISTINCT FROM NULL AS gone FROM customer")
def null_safe(spark: SparkSession, d: str) -> DataFrame:
    s = F.nullif("c_mktsegment", F.lit("FURNITURE"))
    return table(spark, d, "customer").select("c_custkey", (~s.eqNullSafe(F.lit("HOUSEHOLD"))).alias("other"), s.eqNullSafe(F.lit(None)).alias("gone"))


_TYPES = [("S.*", "series"), ("C.*", "class"), ("[0-9]+", "cik")]


@query(
    "expr_type_identifier",
    """WITH ids AS (SELECT c_name AS id FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT p_brand FROM part)
SELECT id, kind FROM (SELECT id, CASE WHEN id LIKE 'S%' THEN 'series' WHEN id LIKE 'C%' THEN 'class' WHEN regexp_full_match(id, '[0-9]+') THEN 'cik' ELSE 'other' END AS kind FROM ids) WHERE kind <> 'other'""",
)
def type_identifier(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    ids = table(spark, d, "customer").select(F.col("c_name").alias("id")).union(table(spark, d, "supplier").select("s_name")).union(part.select(F.col("p_partkey").cast("string"))).union(part.select("p_brand"))
    return exprs.type_identifier(ids, "id", _TYPES, into="kind")


@query("expr_stamp", "SELECT o_orderkey, DATE '2025-01-01' AS as_of, CAST(NULL AS DATE) AS none FROM orders")
def stamp(spark: SparkSession, d: str) -> DataFrame:
    return exprs.stamp(exprs.stamp(table(spark, d, "orders").select("o_orderkey"), "2025-01-01"), "", "none")


@query("expr_clean_text", r"SELECT doc_id, sha256(coalesce(nullif(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), ''), 'NULL')) AS digest FROM documents")
def clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(scalars.clean_text(F.col("text")), F.lit("NULL")), 256).alias("digest"))


_CORPUS = "lower(strip_accents(concat_ws(' ', text, lang, source)))"


@query("expr_search_corpus", f"SELECT doc_id, sha256({_CORPUS}) AS digest, contains({_CORPUS}, 'ecole') OR contains({_CORPUS}, 'tion ea') AS hit FROM documents")
def corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", scalars.search_corpus(F.col("text"), F.col("lang"), F.col("source")).alias("c"))
    return rows.select("doc_id", F.sha2("c", 256).alias("digest"), (exprs.contains_text(F.col("c"), "ECOLE") | exprs.contains_text(F.col("c"), "tion ea")).alias("hit"))


@query(
    "scalar_texts",
    """SELECT o_orderkey, upper(o_orderpriority) AS up, length(o_orderpriority) AS n, substr(o_orderpriority, 3, 4) AS part, split_part(o_orderpriority, '-', 2) AS name, replace(o_orderpriority, '-', ':') AS swapped,
ascii(o_orderpriority) AS code, chr(ascii(o_orderpriority) + 1) AS next, regexp_extract(o_orderpriority, '([0-9]+)-', 1) AS digit, regexp_replace(o_orderpriority, '[A-Z]', 'x', 'g') AS masked, trim(o_orderpriority, '12345') AS bare, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS day FROM orders""",
)
def texts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.upper(p).alias("up"),
        F.length(p).alias("n"),
        F.substring(p, 3, 4).alias("part"),
        F.split_part(p, F.lit("-"), F.lit(2)).alias("name"),
        F.replace(p, F.lit("-"), F.lit(":")).alias("swapped"),
        F.ascii(p).alias("code"),
        F.char(F.ascii(p) + 1).alias("next"),
        F.regexp_extract(p, "([0-9]+)-", 1).alias("digit"),
        F.regexp_replace(p, "[A-Z]", "x").alias("masked"),
        F.expr("trim(BOTH '12345' FROM o_orderpriority)").alias("bare"),
        scalars.iso_date(F.col("o_orderdate").cast("string")).alias("day"),
    )


@query("scalar_numbers", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS r, l_extendedprice / l_quantity AS unit, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio, round(log2(l_quantity), 6) AS bits, round(pow(l_quantity, 2), 2) AS square FROM lineitem")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).alias("r"), (F.col("l_extendedprice") / q).alias("unit"), scalars.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"), F.round(F.log2(q), 6).alias("bits"), F.round(F.pow(q, F.lit(2)), 2).alias("square"))


@query("scalar_distance", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x, i: (CAST(x AS DOUBLE) - (i % 3)) * (CAST(x AS DOUBLE) - (i % 3))))), 6) AS distance FROM embeddings")
def distance(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.transform("embedding", lambda x, i: ((i + 1) % 3).cast("float"))
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.euclidean(F.col("embedding"), fixed), 6).alias("distance"))


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_left_guard", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderstatus = 'F' AND o_custkey = c_custkey")
def guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") == F.col("c_custkey")), "left").select("o_orderkey", "c_name")


@query("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def anti(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "orders").filter("o_totalprice > 250000")
    return table(spark, d, "customer").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_exists_or", "SELECT c_custkey FROM customer c WHERE c_acctbal > 5000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def exists_or(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("x_customer")
    table(spark, d, "orders").createOrReplaceTempView("x_orders")
    return spark.sql("SELECT c_custkey FROM x_customer c WHERE c_acctbal > 5000 OR EXISTS (SELECT 1 FROM x_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")


_CODES = "codes AS (SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0)"


@query(
    "join_prefix_parent",
    f"WITH {_CODES} SELECT code, coalesce(" + ", ".join(f"(SELECT p.code FROM codes p WHERE length(c.code) > {n} AND p.code = substr(c.code, 1, {n}))" for n in (5, 4, 3, 2)) + ") AS parent FROM codes c",
)
def prefix_parent(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("code")).union(table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string"))).distinct()
    return joins.parent_by_prefix(codes, "code", [2, 3, 4, 5])


@query(
    "join_covering_range",
    """WITH r AS (SELECT s_suppkey AS v, CAST(floor(s_acctbal) AS BIGINT) AS lo, CAST(floor(s_acctbal) AS BIGINT) + 900 AS hi FROM supplier), k AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer),
m AS (SELECT k.c_custkey, k.bal, r.v, row_number() OVER (PARTITION BY k.c_custkey ORDER BY r.lo, r.v) AS rn FROM k LEFT JOIN r ON k.bal BETWEEN r.lo AND r.hi) SELECT c_custkey, bal, v AS supplier FROM m WHERE rn = 1""",
)
def covering(spark: SparkSession, d: str) -> DataFrame:
    bal = lambda c: F.floor(c)
    ranges = table(spark, d, "supplier").select("s_suppkey", bal("s_acctbal").alias("lo"), (bal("s_acctbal") + 900).alias("hi"))
    keys = table(spark, d, "customer").select("c_custkey", bal("c_acctbal").alias("bal"))
    return joins.covering_range(keys, "bal", ranges, "lo", "hi", "s_suppkey", "supplier").select("c_custkey", "bal", "supplier")


_BLOCKS = "b AS (SELECT DISTINCT p_name || '/' || p_brand AS id, split_part(p_name, ' ', 2) AS noun, p_brand AS brand, CASE WHEN length(p_name) >= 9 THEN substr(p_name, 1, 5) END AS pre FROM part)"


@query("join_block_pairs", f"WITH {_BLOCKS} SELECT x.id AS l_id, y.id AS r_id FROM b x JOIN b y ON (x.noun = y.noun AND x.brand = y.brand) OR x.pre = y.pre")
def block(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    b = table(spark, d, "part").select(F.concat(n, F.lit("/"), "p_brand").alias("id"), F.split_part(n, F.lit(" "), F.lit(2)).alias("noun"), F.col("p_brand").alias("brand"), F.when(F.length(n) >= 9, F.substring(n, 1, 5)).alias("pre")).distinct()
    return joins.block_pairs(b, b, [["noun", "brand"], ["pre"]], "id", "id")


@query("join_coverage", "SELECT count(*) AS n_rows, count(c_custkey) AS n_matched, CAST(count(c_custkey) AS DOUBLE) / count(*) AS ratio FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'")
def covered(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_coverage(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0"), {"o_custkey": "c_custkey"}, F.col("o_orderstatus") != "P")


@query("join_fk_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return joins.fk_orphans(table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS disc, count(*) FILTER (l_tax > 0.04) AS taxed,
round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS cheap, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""",
)
def basic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.min("l_extendedprice").alias("lo"),
        F.max("l_extendedprice").alias("hi"),
        F.round(F.avg("l_discount"), 6).alias("disc"),
        F.count_if(F.col("l_tax") > 0.04).alias("taxed"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)), 2).alias("cheap"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@query(
    "agg_listed",
    """WITH placed AS (SELECT r_name, n_name, dense_rank() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) FILTER (place <= 3) AS first_three, min(n_name) AS least FROM placed GROUP BY r_name""",
)
def listed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = rows.groupBy("r_name").agg(reshape.listed("n_name").alias("nations"), F.min("n_name").alias("least"))
    return whole.join(reshape.first_values(rows, ["r_name"], "n_name", 3, into="first_three"), "r_name")


@query("agg_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("agg_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.crossJoin(F.broadcast(c.agg(F.avg("c_acctbal").alias("m")))).filter("c_acctbal > m").select("c_custkey")  # one row


@query("window_rank_global", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def rank(spark: SparkSession, d: str) -> DataFrame:
    return windows.rank_global(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")]).select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("window_tie_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n_equiv FROM orders")
def ties(spark: SparkSession, d: str) -> DataFrame:
    return windows.tie_size(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"]).select("o_orderkey", "n_equiv")


@query("window_minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS scaled FROM part")
def minmax(spark: SparkSession, d: str) -> DataFrame:
    return windows.minmax_scale(table(spark, d, "part"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_scaled", 9).alias("scaled"))


@query("window_distinct_on", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber, l_partkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc_nulls_last(), F.col("l_linenumber"), F.col("l_partkey")]
    return windows.best_per_key(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("window_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(25)


@query("window_list_position", "SELECT o_orderkey, list_position(['F', 'O'], o_orderstatus) AS place FROM orders")
def place(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", exprs.position_in(F.col("o_orderstatus"), ["F", "O"]).alias("place"))


@query("window_seeded_sample", "SELECT n AS asked, least(n, count(*)) AS n_rows, least(n, count(*)) AS n_members, 0 AS n_passed_over, least(n, count(*)) AS n_again FROM orders, (VALUES (100), (11000), (100000000)) AS v(n) GROUP BY n")
def sample(spark: SparkSession, d: str) -> DataFrame:
    """Samples of several sizes: rows, those that the table has, rows left out though their hash is smaller than one taken, and rows that a sample of another layout has too."""
    orders = table(spark, d, "orders").select("o_orderkey")
    out = []
    for n in (100, 11_000, 100_000_000):
        one = windows.seeded_sample(orders, n, "o_orderkey").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("taken"))
        other = windows.seeded_sample(orders.repartition(5), n, "o_orderkey").select(F.col("o_orderkey").alias("j"), F.lit(1).alias("again"))
        rows = orders.join(one, F.col("o_orderkey") == F.col("k"), "left").join(other, F.col("o_orderkey") == F.col("j"), "left")
        hashed = rows.withColumn("h", F.xxhash64("o_orderkey", F.lit(42)))
        most = hashed.agg(F.max(F.when(F.col("taken") == 1, F.col("h"))).alias("most"))
        counts = hashed.crossJoin(F.broadcast(most)).agg(F.count("taken").alias("n_members"), F.count_if(F.col("taken").isNull() & (F.col("h") < F.col("most"))).alias("n_passed_over"), F.count_if((F.col("taken") == 1) & (F.col("again") == 1)).alias("n_again"))  # one row
        out.append(one.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(counts).select(F.lit(n).alias("asked"), "*"))
    return reshape.union_by_name(*out)


@query("window_surrogate_id", "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}') AS row_id FROM customer")
def surrogate(spark: SparkSession, d: str) -> DataFrame:
    return windows.surrogate_id(table(spark, d, "customer"), ["c_custkey", "c_name"]).select("c_custkey", "row_id")


@query("window_total_order", "SELECT o_orderdate, count(*) AS n_rows FROM orders GROUP BY o_orderdate HAVING count(*) > 1")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    return windows.assert_total_order(table(spark, d, "orders"), ["o_orderdate"])


@query("window_retain", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def retain(spark: SparkSession, d: str) -> DataFrame:
    return windows.retain_newest(table(spark, d, "events"), "user_id", [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("set_union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionAll(table(spark, d, "supplier").select("s_name", "s_nationkey"))


@query("set_union_by_name", "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_nationkey AS nation, s_name AS name FROM supplier")
def by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return reshape.union_by_name(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))


@query(
    "set_rowset_diff",
    """WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s FROM customer), b AS (SELECT c_nationkey AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 0)
SELECT coalesce(x.k, y.k) AS k, coalesce(x.s, y.s) AS s, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM (SELECT k, s, count(*) AS n FROM a GROUP BY 1, 2) x FULL JOIN (SELECT k, s, count(*) AS n FROM b GROUP BY 1, 2) y ON x.k = y.k AND x.s = y.s WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""",
)
def diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    pick = lambda x: x.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"))
    return reshape.rowset_diff(pick(c), pick(c.filter("c_acctbal > 0")))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("reshape_pivot", "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 4) AS \"{k}\"" for k in _KINDS) + " FROM events GROUP BY user_id")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = reshape.pivot_sum(table(spark, d, "events"), ["user_id"], "event_type", _KINDS, "value")
    return wide.select("user_id", *[F.round(k, 4).alias(k) for k in _KINDS])


@query("reshape_unpivot", "SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "field", "value")


@query("reshape_explode", "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations")
def exploded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n", -1)).alias("line"))


@query("reshape_upsert", "SELECT c_custkey, 0.0 AS c_acctbal FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT -s_suppkey - 1, s_acctbal FROM supplier")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    new = c.filter("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(table(spark, d, "supplier").select(-F.col("s_suppkey") - 1, "s_acctbal"))
    return reshape.upsert(c.select("c_custkey", "c_acctbal"), new, ["c_custkey"])


@query("scalar_json_index", "SELECT o_orderkey, o_orderstatus AS first, CAST(o_custkey AS VARCHAR) AS second, CAST(NULL AS VARCHAR) AS fourth FROM orders")
def json_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('["'), "o_orderstatus", F.lit('", '), F.col("o_custkey").cast("string"), F.lit(", {}]")).alias("j"))
    return rows.select("o_orderkey", *[scalars.json_at(F.col("j"), k).alias(n) for k, n in ((0, "first"), (1, "second"), (3, "fourth"))])


@query("expr_checked", "SELECT o_orderkey, o_totalprice FROM orders")
def checked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", scalars.checked(F.col("o_totalprice"), F.col("o_totalprice") >= 0, "negative price").alias("o_totalprice"))


@query(
    "set_recursive",
    "WITH RECURSIVE r(top, k, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT top, k // 3, depth + 1 FROM r WHERE k > 0) SELECT top, max(depth) AS depth, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM r GROUP BY top",
)
def recursive(spark: SparkSession, d: str) -> DataFrame:
    """A recursive query over all parts: each number divided until nothing is left."""
    base = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("top"), F.col("p_partkey").cast("long").alias("k"), F.lit(0).alias("depth"))
    all_of = fixpoint(base, lambda last: last.filter("k > 0").selectExpr("top", "k DIV 3 AS k", "depth + 1 AS depth"), distinct=False)
    return all_of.groupBy("top").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query(
    "set_recursive_union",
    """WITH RECURSIVE m(k) AS (SELECT c_custkey FROM customer UNION SELECT unnest([k // 3, k // 7]) FROM m WHERE k > 0) SELECT count(*) AS n, max(k) AS largest, CAST(sum(k) AS BIGINT) AS total FROM m""",
)
def recursive_union(spark: SparkSession, d: str) -> DataFrame:
    """All numbers that two rules meet from the customers' keys on, each once."""
    met = fixpoint(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k")), lambda last: last.filter("k > 0").selectExpr("explode(array(k DIV 3, k DIV 7)) AS k"))
    return met.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("largest"), F.sum("k").alias("total"))


@query(
    "join_foreign_keys",
    """SELECT 'orders.o_custkey->customer.c_custkey' AS edge, 'checked' AS status, (SELECT count(*) FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS orphans
UNION ALL SELECT 'customer.c_nationkey->nation.n_nationkey', 'checked', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'supplier.s_nationkey->region.r_regionkey', 'review', NULL""",
)
def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, n) for n in ("orders", "nation", "region", "supplier")} | {"customer": table(spark, d, "customer").filter("c_nationkey < 20")}
    edge = lambda c, ck, p, pk, s: {"child": c, "child_key": ck, "parent": p, "parent_key": pk, "status": s}
    edges = [edge("orders", "o_custkey", "customer", "c_custkey", "accepted"), edge("supplier", "s_nationkey", "region", "r_regionkey", "proposed"), edge("customer", "c_nationkey", "nation", "n_nationkey", "accepted")]
    return joins.foreign_key_report(tables, edges)


@query(
    "sql_functions",
    """SELECT o_orderkey, CAST(o_orderkey % 97 AS INTEGER) AS remainder, CAST(o_custkey AS VARCHAR) AS customer, regexp_extract(o_orderpriority, '"?([^"]*)', 1) AS priority, CAST(o_custkey * 1000 AS INTEGER) AS amount, DATE '2025-02-03' AS as_of, CAST(NULL AS VARCHAR) AS note,
o_totalprice / nullif(o_custkey % 5, 0) AS share FROM orders WHERE o_totalprice > 100000""",
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The library's scalars and session variables in a SQL text."""
    define_functions(spark, "t_")
    set_variables(spark, {"t_least": 100000.0, "t_as_of": datetime.date(2025, 2, 3), "t_note": ""})
    table(spark, d, "orders").createOrReplaceTempView("t_orders")
    return spark.sql(
        """SELECT o_orderkey, t_mod97(' ' || o_orderkey) AS remainder, t_unpad('000' || o_custkey) AS customer, t_json_at('["' || o_orderpriority || '"]', 0) AS priority, t_thousands(o_custkey || ',000') AS amount, t_as_of AS as_of,
CAST(t_note AS STRING) AS note, t_ratio(o_totalprice, o_custkey % 5) AS share FROM t_orders WHERE o_totalprice > t_least"""
    )
