"""Entity resolution over part names: a register by name and brand, and perturbed names on the left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import query
from tesserae.functions.scalars import jaro_winkler
from tesserae.operators import resolution as er
from tesserae.operators.joins import block_pairs, largest_blocks
from tesserae.operators.windows import best_per_key, rank_global
from tesserae.session import fresh_path, ship, table

_CONST = f"""
suffixes AS (SELECT {er.SUFFIXES!r} AS list),
"""
# words of the name; the last of several goes if it is a suffix
_WORDS = "list_filter(string_split(regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', ' ', 'g'), ' '), lambda w: w <> '')"
_NORM = "(SELECT array_to_string(CASE WHEN len(ws) > 1 AND list_contains(list, ws[-1]) THEN ws[:-2] ELSE ws END, ' ') FROM (SELECT list, " + _WORDS + " AS ws FROM suffixes))"

_REGISTER_SQL = """
register AS (SELECT p_brand || '/' || p_name AS uid, p_name || CASE WHEN min(p_size) % 2 = 0 THEN ' Inc.' ELSE '' END AS legal_name,
  CASE WHEN max(p_size) % 3 = 0 THEN 'US-DE' ELSE 'FR' END AS jurisdiction, CASE WHEN max(p_size) % 3 = 0 THEN 'US' ELSE 'FR' END AS country,
  CASE WHEN min(p_partkey) % 5 = 0 THEN 'PENDING' WHEN min(p_partkey) % 5 < 3 THEN 'ISSUED' WHEN min(p_partkey) % 5 = 3 THEN 'LAPSED' ELSE 'RETIRED' END AS reg_status
  FROM part GROUP BY p_brand, p_name),
filers AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN p_name || ' Corp.' WHEN p_partkey % 4 = 1 THEN upper(p_name) WHEN p_partkey % 4 = 2 THEN left(p_name, length(p_name) - 1) || 'x' ELSE 'The ' || p_name END AS name FROM part),
"""


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    g = part.groupBy("p_brand", "p_name").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_partkey").alias("k"))
    us = F.col("hi") % 3 == 0
    k = F.col("k") % 5
    return g.select(
        F.concat("p_brand", F.lit("/"), "p_name").alias("uid"),
        F.concat("p_name", F.when(F.col("lo") % 2 == 0, " Inc.").otherwise("")).alias("legal_name"),
        F.when(us, "US-DE").otherwise("FR").alias("jurisdiction"),
        F.when(us, "US").otherwise("FR").alias("country"),
        F.when(k == 0, "PENDING").when(k < 3, "ISSUED").when(k == 3, "LAPSED").otherwise("RETIRED").alias("reg_status"),
    )


def filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.col("p_name")
    cut = F.concat(F.substr(name, F.lit(1), F.length(name) - 1), F.lit("x"))
    changed = F.when(k == 0, F.concat(name, F.lit(" Corp."))).when(k == 1, F.upper(name)).when(k == 2, cut).otherwise(F.concat(F.lit("The "), name))
    return table(spark, sf_dir, "part").select(changed.alias("name")).distinct().withColumn("uid", F.col("name"))


_RAW = "p_name || CASE WHEN p_partkey % 3 = 0 THEN '  Holdings' WHEN p_partkey % 3 = 1 THEN ', Ltd.' ELSE '' END"


@query("er_normalize_name", f"WITH {_CONST.strip().rstrip(',')} SELECT p_partkey, {_NORM.format(_RAW)} AS nname FROM part")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.concat("p_name", F.when(k == 0, "  Holdings").when(k == 1, ", Ltd.").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", er.normalize_name(raw).alias("nname"))


# a key is there where the text that it is cut from is long enough: (key, least length, characters kept)
_KEY_RULES = "rules(kind, least, kept) AS (VALUES ('p6', 6, 6), ('p8', 8, 8), ('tok', 4, 1000000), ('ex', 2, 1000000))"
# long form of the keys of a table of (uid, nname): one row for each key that a name has
_KEYED = """
{0}_words AS (SELECT *, list_filter(string_split(nname, ' '), lambda w: w <> '') AS ws FROM {0}),
{0}_cores AS (SELECT * EXCLUDE (ws), array_to_string(CASE WHEN list_contains(STOP, ws[1]) THEN ws[2:] ELSE ws END, ' ') AS core FROM {0}_words),
{0}_keys AS (SELECT c.*, kind, left(part, kept) AS key FROM (SELECT *, unnest([{{'k': 'p6', 'p': core}}, {{'k': 'p8', 'p': core}}, {{'k': 'ex', 'p': core}}, {{'k': 'tok', 'p': string_split(core, ' ')[1]}}]) AS o FROM {0}_cores) c, LATERAL (SELECT o.p AS part) t JOIN rules ON kind = o.k AND length(t.part) >= least)
""".replace("STOP", repr(er.STOPWORDS))


@query(
    "er_blocking_keys",
    "WITH "
    + _CONST
    + _REGISTER_SQL
    + _KEY_RULES
    + f", named AS (SELECT name AS uid, {_NORM.format('name')} AS nname FROM filers),"
    + _KEYED.format("named")
    + """SELECT c.uid, c.nname, c.core, max(key) FILTER (kind = 'p6') AS blk_p6, max(key) FILTER (kind = 'p8') AS blk_p8, max(key) FILTER (kind = 'tok') AS blk_tok, max(key) FILTER (kind = 'ex') AS blk_exact
FROM named_cores c LEFT JOIN named_keys k ON k.uid = c.uid GROUP BY c.uid, c.nname, c.core""",
)
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = filers(spark, sf_dir).select("uid", er.normalize_name(F.col("name")).alias("nname"))
    return er.blocking_keys(named, "nname")


# distinct part names that share their first word
_PAIRS_SQL = "SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) WHERE x.p_name <= y.p_name"


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    pairs = block_pairs(names, names, [["word"]], "p_name", "p_name", hot=2_000)
    return pairs.filter("l_id <= r_id").toDF("a", "b")


@query("er_jaro_winkler", f"SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS similarity FROM ({_PAIRS_SQL})")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _name_pairs(spark, sf_dir).withColumn("similarity", F.round(jaro_winkler(F.col("a"), F.col("b")), 9))


@query(
    "er_largest_blocks",
    """WITH n AS (SELECT split_part(p_name, ' ', 1) AS key, count(DISTINCT p_name) AS c FROM part GROUP BY 1)
(SELECT 'word' AS rule, key, c AS n_left, c AS n_right, c * c AS n_pairs FROM n ORDER BY n_pairs DESC, key LIMIT 5)""",
)
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return largest_blocks(names, names, [["word"]])


_LEVEL_SQL = "CASE WHEN s >= 1 THEN 0 WHEN s >= 0.95 THEN 1 WHEN s >= 0.92 THEN 2 WHEN s >= 0.88 THEN 3 ELSE 4 END"
_BAYES_SQL = "CASE level WHEN 0 THEN 0.80 / 1e-6 WHEN 1 THEN 0.12 / 1e-5 WHEN 2 THEN 0.04 / 1e-4 WHEN 3 THEN 0.02 / 1e-3 ELSE 0.02 / 0.998889 END"


@query(
    "er_fellegi_sunter",
    f"""WITH p AS (SELECT a, b, jaro_winkler_similarity(a, b) AS s FROM ({_PAIRS_SQL})), l AS (SELECT a, b, {_LEVEL_SQL} AS level FROM p),
w AS (SELECT a, b, level, log2(CAST(0.01 AS DOUBLE) / 0.99 * {_BAYES_SQL}) AS w FROM l)
SELECT a, b, level, round(w, 6) AS match_weight, round(pow(2, w) / (1 + pow(2, w)), 9) AS match_probability FROM w""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _name_pairs(spark, sf_dir).withColumn("level", er.level_of(jaro_winkler(F.col("a"), F.col("b")))).withColumn("w", er.fs_weight(F.col("level")))
    return rows.select("a", "b", "level", F.round("w", 6).alias("match_weight"), F.round(er.fs_probability(F.col("w")), 9).alias("match_probability"))


# The best of a left row's scored register rows is the least of (level, trust, abroad, id); a tie is counted by a grouped count.
_EDGES_SQL = (
    "WITH "
    + _CONST
    + _REGISTER_SQL
    + _KEY_RULES
    + f""", trusted(reg_status, trust) AS (VALUES {', '.join(f"('{s}', {k})" for k, s in enumerate(er.STATUSES))}),
wanted AS (SELECT name AS uid, {_NORM.format('name')} AS nname FROM filers),
known AS (SELECT uid, {_NORM.format('legal_name')} AS nname, country, trust, CAST(NOT starts_with(jurisdiction, 'US') AS INTEGER) AS abroad FROM register JOIN trusted USING (reg_status)),"""
    + _KEYED.format("wanted")
    + ","
    + _KEYED.format("known")
    + f""", met AS (SELECT DISTINCT w.uid AS l_uid, w.nname AS l_name, k.uid AS r_uid, k.nname AS r_name, trust, abroad FROM wanted_keys w JOIN known_keys k ON w.kind = k.kind AND w.key = k.key WHERE w.kind IN ('p8', 'ex') OR k.country = 'US'),
graded AS (SELECT *, {_LEVEL_SQL} AS level FROM (SELECT *, jaro_winkler_similarity(l_name, r_name) AS s FROM met)),
weighed AS (SELECT *, log2(CAST(0.01 AS DOUBLE) / 0.99 * {_BAYES_SQL}) AS w FROM graded),
sure AS (SELECT *, 1 - 1 / (1 + pow(2, w)) AS prob FROM weighed WHERE 1 - 1 / (1 + pow(2, w)) >= 0.30),
ties AS (SELECT l_uid, level, trust, abroad, count(*) AS n FROM sure GROUP BY ALL),
top AS (SELECT l_uid, min({{'level': level, 'trust': trust, 'abroad': abroad, 'id': r_uid}}) AS best FROM sure GROUP BY l_uid),
edges AS (SELECT top.l_uid, best.id AS r_uid, legal_name, jurisdiction, reg_status, round(w, 6) AS match_weight, round(prob, 9) AS match_probability, ['jaro_winkler', 'exact_name'][1 + CAST(l_name = r_name AS INTEGER)] AS method,
  ['candidate', 'confirmed', 'ambiguous'][1 + CAST(l_name = r_name AS INTEGER) * CAST(least(n, 2) AS INTEGER)] AS status
  FROM top JOIN sure ON sure.l_uid = top.l_uid AND sure.r_uid = best.id JOIN ties ON ties.l_uid = top.l_uid AND (ties.level, ties.trust, ties.abroad) = (best.level, best.trust, best.abroad) JOIN register g ON g.uid = best.id)
"""
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return er.resolve(filers(spark, sf_dir), register(spark, sf_dir))


@query("er_resolve_parts", _EDGES_SQL + "SELECT l_uid AS name, r_uid, legal_name, jurisdiction, reg_status, match_weight, match_probability, method, status FROM edges")
def resolve_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _edges(spark, sf_dir)
    return out.select("name", "r_uid", "legal_name", "jurisdiction", "reg_status", F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 9).alias("match_probability"), "method", "status")


@query(
    "er_coverage",
    _EDGES_SQL
    + """SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM filers), 1) AS pct, round(avg(match_probability), 3) AS avg_p,
count(*) FILTER (method = 'exact_name') AS exact, count(*) FILTER (method = 'jaro_winkler') AS fuzzy FROM edges GROUP BY status""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.coverage(_edges(spark, sf_dir), filers(spark, sf_dir))


@query("er_export", _EDGES_SQL + "SELECT l_uid, r_uid, status, row_number() OVER (ORDER BY l_uid, r_uid) AS place FROM edges")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported edges and the place of each over the files of the export, by file and row."""
    path = fresh_path(spark, "edges")
    er.export(_edges(spark, sf_dir), path)
    rows = spark.read.parquet(path).select("l_uid", "r_uid", "status", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rank_global(rows, [F.col("file"), F.col("row")], into="place").select("l_uid", "r_uid", "status", F.col("place").cast("long").alias("place"))


@query("er_spot_check", _EDGES_SQL + "SELECT l_uid, status, method FROM edges WHERE l_uid IN (SELECT upper(min(p_name)) FROM part UNION ALL SELECT upper(max(p_name)) FROM part)")
def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "part").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    ids = ends.select(F.explode(F.array(F.upper("a"), F.upper("b"))).alias("l_uid"))
    return er.spot_check(_edges(spark, sf_dir), ids).select("l_uid", "status", "method")


@query("er_best_edge", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return best_per_key(rows, ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()])
