"""Crosswalk edges, code lists and trends built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import query
from tesserae.functions.scalars import mod97
from tesserae.operators import codelists, crosswalk, trending
from tesserae.session import table

# identifiers of 18 characters and two digits; every third has right check digits
_BODY_SQL = "lpad(CAST(o_custkey AS VARCHAR), 9, '0') || 'AZ' || lpad(CAST(o_orderkey % 9999991 AS VARCHAR), 7, '0')"
# letters become two digits each; the first 18 digits are reduced, and what is left fits a 128-bit integer
_DIGITS = "array_to_string(list_transform(string_split({0}, ''), lambda c: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1 AS VARCHAR)), '')"
_CLEAN = "upper(trim({0}))"
_FOLDED = "CAST(CAST(CAST(CAST(left(" + _DIGITS + ", 18) AS HUGEINT) % 97 AS VARCHAR) || substr(" + _DIGITS + ", 19) AS HUGEINT) % 97 AS INTEGER)"
_MOD = "CASE WHEN regexp_full_match(" + _CLEAN + ", '[0-9A-Z]+') THEN " + _FOLDED.replace("{0}", _CLEAN) + " END"
_IDS_SQL = f"""ids AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN b || lpad(CAST(98 - {_MOD.format("b || '00'")} AS VARCHAR), 2, '0') WHEN o_orderkey % 3 = 1 THEN b || '00' WHEN o_orderkey % 30 = 2 THEN ' ' || lower(b) || '!1' ELSE NULL END AS lei
FROM (SELECT o_orderkey, o_custkey, {_BODY_SQL} AS b FROM orders))"""


def ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("AZ"), F.lpad((k % 9999991).cast("string"), 7, "0"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", body.alias("b"))
    b = F.col("b")
    check = F.lpad((98 - mod97(F.concat(b, F.lit("00")))).cast("string"), 2, "0")
    lei = F.when(k % 3 == 0, F.concat(b, check)).when(k % 3 == 1, F.concat(b, F.lit("00"))).when(k % 30 == 2, F.concat(F.lit(" "), F.lower(b), F.lit("!1")))
    return rows.select("o_orderkey", "o_custkey", lei.alias("lei"))


_REG_SQL = "reg AS (SELECT upper(trim(lei)) AS lei, min(c_name) AS legal_name, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'US-NY' ELSE 'DE' END AS jurisdiction, 'ISSUED' AS reg_status FROM ids JOIN customer ON c_custkey = o_custkey WHERE lei IS NOT NULL AND o_orderkey % 4 <> 1 GROUP BY 1)"


def register(spark: SparkSession, d: str) -> DataFrame:
    rows = ids(spark, d).filter("lei IS NOT NULL AND o_orderkey % 4 <> 1").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.upper(F.trim("lei")).alias("lei")).agg(F.min("c_name").alias("legal_name"), F.when(F.min("o_orderkey") % 2 == 0, "US-NY").otherwise("DE").alias("jurisdiction"), F.lit("ISSUED").alias("reg_status"))


@query("cw_mod97", f"WITH {_IDS_SQL} SELECT o_orderkey, lei, {_MOD.format('lei')} AS remainder FROM ids")
def remainder(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("o_orderkey", "lei", mod97(F.col("lei")).alias("remainder"))


@query("cw_admit", f"WITH {_IDS_SQL}, {_REG_SQL} SELECT o_orderkey, lei FROM ids WHERE coalesce({_MOD.format('lei')} = 1, FALSE) OR EXISTS (SELECT 1 FROM reg WHERE reg.lei = upper(trim(ids.lei)))")
def admitted(spark: SparkSession, d: str) -> DataFrame:
    return crosswalk.admit(ids(spark, d), "lei", register(spark, d), "lei").select("o_orderkey", "lei")


_EDGES_SQL = f"""WITH {_IDS_SQL}, {_REG_SQL},
src AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'cik' ELSE 'series' END AS key_type, CAST(o_custkey AS VARCHAR) AS key, upper(trim(lei)) AS lei, 'FUND' AS category, 'filing' AS method, 'authoritative' AS tier, 1.0 AS confidence FROM ids WHERE lei IS NOT NULL AND o_orderkey % 6 < 4
  UNION ALL BY NAME SELECT 'cik' AS key_type, CAST(o_custkey AS VARCHAR) AS key, upper(trim(lei)) AS lei, 'registration' AS method, 'authoritative' AS tier, 1.0 AS confidence FROM ids WHERE lei IS NOT NULL AND o_custkey % 5 = 0),
resolved AS (SELECT CAST(c_custkey AS VARCHAR) AS key, lpad(CAST(c_nationkey AS VARCHAR), 20, '7') AS lei, 'jaro_winkler' AS method, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'candidate' WHEN 2 THEN 'ambiguous' ELSE 'weak' END AS status, 0.5 + (c_custkey % 50) / 100.0 AS match_probability FROM customer),
sure AS (SELECT e.* FROM (SELECT arg_min({{'key_type': key_type, 'key': key, 'lei': lei, 'category': category, 'method': method, 'tier': tier, 'confidence': CAST(confidence AS DOUBLE)}}, {{'sure': -CAST(confidence AS DOUBLE), 'how': method, 'kind': coalesce(category, '~')}}) AS e FROM src GROUP BY key_type, key, lei)),
open_keys AS (SELECT key FROM resolved EXCEPT SELECT key FROM sure WHERE key_type = 'cik'),
edges AS (SELECT * FROM sure UNION ALL BY NAME SELECT 'cik' AS key_type, key, upper(lei) AS lei, method, status AS tier, CAST(match_probability AS DOUBLE) AS confidence FROM open_keys JOIN resolved USING (key) WHERE list_contains(['confirmed', 'candidate', 'ambiguous'], status))
"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = ids(spark, d).filter("lei IS NOT NULL")
    key, lei = F.col("o_custkey"), F.col("lei")
    filing = crosswalk.typed_edges(rows.filter("o_orderkey % 6 < 4"), key, lei, F.when(F.col("o_orderkey") % 2 == 0, "cik").otherwise("series"), "filing", category="FUND")
    registration = crosswalk.typed_edges(rows.filter("o_custkey % 5 = 0"), key, lei, "cik", "registration")
    k = F.col("c_custkey")
    resolved = table(spark, d, "customer").select(
        k.cast("string").alias("key"),
        F.lpad(F.col("c_nationkey").cast("string"), 20, "7").alias("lei"),
        F.lit("jaro_winkler").alias("method"),
        F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "candidate").when(k % 4 == 2, "ambiguous").otherwise("weak").alias("status"),
        (F.lit(0.5) + (k % 50) / F.lit(100.0)).alias("match_probability"),
    )
    return crosswalk.build_edges([filing, registration], resolved)


@query("cw_edges", _EDGES_SQL + "SELECT key_type, key, lei, category, method, tier, round(confidence, 6) AS confidence FROM edges")
def built(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).withColumn("confidence", F.round("confidence", 6))


# what is known of an edge as rows (what, choice, value), the lowest choice first; a text has its words by place
_ENRICHED_SQL = (
    _EDGES_SQL
    + """, facts(key_type, key, lei, what, choice, value) AS (SELECT key_type, key, lei, 'ticker', 0, o_orderpriority FROM edges JOIN orders ON key_type = 'cik' AND key = CAST(o_custkey AS VARCHAR)
  UNION ALL SELECT key_type, key, lei, 'name', 1, 'Acmé ' || c_name FROM edges JOIN customer ON key_type = 'cik' AND key = CAST(c_custkey AS VARCHAR) WHERE c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT key_type, key, lei, unnest(['name', 'legal', 'place', 'standing']), 2, unnest([legal_name, legal_name, jurisdiction, reg_status]) FROM edges JOIN reg USING (lei)
  UNION ALL SELECT key_type, key, lei, 'kind', unnest([1, 2]), unnest([category, 'GENERAL']) FROM edges),
firsts AS (SELECT key_type, key, lei, what, arg_min(value, choice) AS value FROM facts WHERE value IS NOT NULL AND what <> 'ticker' GROUP BY ALL UNION ALL SELECT key_type, key, lei, 'ticker', string_agg(DISTINCT value, ',' ORDER BY value) FROM facts WHERE what = 'ticker' GROUP BY ALL
  UNION ALL SELECT key_type, key, lei, 'lei', lei FROM edges),
texts AS (SELECT key_type, key, lei, strip_accents(lower(string_agg(value, ' ' ORDER BY place))) AS corpus FROM firsts JOIN (VALUES ('name', 1), ('legal', 2), ('ticker', 3), ('lei', 4)) AS places(what, place) USING (what) GROUP BY ALL),
cards AS (PIVOT firsts ON what IN ('name', 'legal', 'place', 'standing', 'kind', 'ticker') USING max(value) GROUP BY key_type, key, lei),
out AS (SELECT key_type, key, ticker, name AS company_name, lei, legal AS legal_name, kind AS category, place AS jurisdiction, standing AS reg_status, method, tier, round(confidence, 6) AS confidence, DATE '2025-06-30' AS as_of, corpus
  FROM edges JOIN cards USING (key_type, key, lei) JOIN texts USING (key_type, key, lei))
"""
)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    names = names.select(F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit("Acmé "), "c_name").alias("company_name"), F.col("o_orderpriority").alias("ticker"))
    return crosswalk.enrich_edges(edges(spark, d), register(spark, d), names, as_of="2025-06-30")


@query("cw_enriched", _ENRICHED_SQL + "SELECT * FROM out")
def enrich(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d)


@query(
    "cw_gate",
    _ENRICHED_SQL
    + f", bad AS (SELECT lei FROM out ANTI JOIN reg USING (lei) WHERE coalesce({_MOD.format('lei')}, 0) <> 1) SELECT count(*) AS edges, count(DISTINCT lei) AS distinct_leis, (SELECT string_agg(lei, ', ' ORDER BY lei) FROM (SELECT DISTINCT lei FROM bad ORDER BY lei LIMIT 5)) AS examples FROM bad HAVING count(*) > 0",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    return crosswalk.unadmitted(enriched(spark, d), register(spark, d))


@query(
    "cw_entity_universe",
    """WITH lines AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN ':' || c_custkey || ':' WHEN c_custkey % 7 = 0 THEN c_name ELSE c_name || ' : ' || c_mktsegment || ':' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || ':' END AS value FROM customer),
p AS (SELECT CAST(CAST(regexp_extract(value, ':([0-9]+):$', 1) AS BIGINT) AS VARCHAR) AS cik, trim(regexp_replace(value, ':[0-9]+:$', '')) AS company_name FROM lines WHERE regexp_matches(value, '^.+:[0-9]+:$')),
t AS (SELECT CAST(o_custkey AS VARCHAR) AS cik, min(o_orderpriority) AS ticker FROM orders GROUP BY 1) SELECT p.cik, company_name, ticker FROM p LEFT JOIN t ON p.cik = t.cik WHERE company_name <> ''""",
)
def universe(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    value = F.when(k % 11 == 0, F.concat(F.lit(":"), k.cast("string"), F.lit(":"))).when(k % 7 == 0, n).otherwise(F.concat(n, F.lit(" : "), "c_mktsegment", F.lit(":"), F.lpad(k.cast("string"), 10, "0"), F.lit(":")))
    tickers = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderpriority").alias("ticker"))
    return crosswalk.entity_universe(table(spark, d, "customer").select(value.alias("value")), tickers)


_NAICS_SQL = """raw AS (SELECT DISTINCT code, title FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN CAST(20 + n_nationkey AS VARCHAR) || '-' || CAST(23 + n_nationkey AS VARCHAR) END AS code, n_name || 'T' AS title FROM nation
UNION ALL SELECT CAST(24 + 5 * CAST(n_nationkey / 5 AS INTEGER) AS VARCHAR), 'Single*' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT CAST(200 + p_partkey % 260 AS VARCHAR), 'Sub' FROM part UNION ALL SELECT CAST(2000 + p_partkey % 2600 AS VARCHAR), 'Group' FROM part UNION ALL SELECT CAST(20000 + p_partkey AS VARCHAR), p_type FROM part) WHERE code IS NOT NULL),
depths(digits, level) AS (VALUES (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)),
n AS (SELECT code, rtrim(title, 'T*') AS title, level FROM raw JOIN depths ON digits = strpos(code || '-', '-') - 1)"""


def industry_raw(spark: SparkSession, d: str) -> DataFrame:
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    k, p = F.col("n_nationkey"), F.col("p_partkey")
    fives = nation.filter("n_nationkey % 5 = 0")
    rows = fives.select(F.concat((k + 20).cast("string"), F.lit("-"), (k + 23).cast("string")).alias("code"), F.concat("n_name", F.lit("T")).alias("title"))
    rows = rows.union(fives.select((k + 24).cast("string"), F.lit("Single*")))
    for base, mod, title in ((200, 260, F.lit("Sub")), (2000, 2600, F.lit("Group"))):
        rows = rows.union(part.select((base + p % mod).cast("string"), title))
    return rows.union(part.select((20000 + p).cast("string"), "p_type")).distinct()


@query(
    "code_industry",
    f"""WITH {_NAICS_SQL}, sectors AS (SELECT code, CAST(string_split(code, '-')[1] AS INTEGER) AS lo, CAST(string_split(code, '-')[-1] AS INTEGER) AS hi FROM n WHERE level = 1),
hung AS (SELECT n.code, arg_min(s.code, s.lo) AS sector FROM n JOIN sectors s ON length(n.code) = 3 AND CAST(left(n.code, 2) AS INTEGER) BETWEEN s.lo AND s.hi GROUP BY n.code)
SELECT n.code, title, CAST(level AS INTEGER) AS level, CASE level WHEN 1 THEN NULL WHEN 2 THEN sector ELSE left(n.code, length(n.code) - 1) END AS parent, DATE '2025-01-01' AS as_of FROM n LEFT JOIN hung ON hung.code = n.code""",
)
def industry(spark: SparkSession, d: str) -> DataFrame:
    return codelists.industry_list(industry_raw(spark, d), "2025-01-01")


# fixed values: the level that a code's length stands for; a range is a sector, and a code of another length has no level
_LEVEL_NAMES_SQL = "names(digits, level) AS (VALUES (2, 'sector'), (3, 'subsector'), (4, 'industry_group'), (5, 'naics_industry'), (6, 'national_industry'))"


@query("code_level_names", f"WITH {_NAICS_SQL}, {_LEVEL_NAMES_SQL} SELECT DISTINCT code, names.level FROM raw LEFT JOIN names ON digits = CASE WHEN contains(code, '-') THEN 2 ELSE length(code) END")
def level_names(spark: SparkSession, d: str) -> DataFrame:
    return industry_raw(spark, d).select("code").distinct().select("code", codelists.industry_level_name(F.col("code")).alias("level"))


_ICD_SQL = "codes AS (SELECT code, min(title) AS title FROM (SELECT 'A' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_type AS title FROM part UNION ALL SELECT 'A' || lpad(CAST(p_size AS VARCHAR), 2, '0') || substr(CAST(p_partkey AS VARCHAR), 1, 1 + p_partkey % 4), p_name FROM part) GROUP BY code)"


@query(
    "code_diagnosis",
    f"WITH {_ICD_SQL} SELECT code, title, CAST(length(code) - 2 AS INTEGER) AS level, coalesce(" + ", ".join(f"(SELECT p.code FROM codes p WHERE length(c.code) > {n} AND p.code = substr(c.code, 1, {n}))" for n in (6, 5, 4, 3)) + ") AS parent, CAST(NULL AS DATE) AS as_of FROM codes c",
)
def diagnosis(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    head = F.concat(F.lit("A"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    tail = F.substr(F.col("p_partkey").cast("string"), F.lit(1), (1 + F.col("p_partkey") % 4).cast("int"))
    raw = part.select(head.alias("code"), F.col("p_type").alias("title")).union(part.select(F.concat(head, tail), "p_name"))
    return codelists.diagnosis_list(raw.groupBy("code").agg(F.min("title").alias("title")))


_COUNTS_SQL = """c AS (SELECT user_id, event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-21') AS d30, count(*) AS d90 FROM events GROUP BY 1, 2),
a AS (SELECT *, d30 / 30 AS d30_avg, (d90 - d30) / 60 AS p60_avg, CASE WHEN d30 / 30 < 0.1 THEN 0 ELSE ((d90 - d30) / 60) / (d30 / 30) END AS trend_index FROM c),
s AS (SELECT *, coalesce((trend_index - min(trend_index) OVER ()) / nullif(max(trend_index) OVER () - min(trend_index) OVER (), 0), 0) AS t, coalesce((d30 - min(d30) OVER ()) / nullif(max(d30) OVER () - min(d30) OVER (), 0), 0) AS r FROM a),
m AS (SELECT *, sqrt((1 - t) * (1 - t) + (1 - r) * (1 - r)) AS distance FROM s)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("ts") >= F.lit("2024-01-21").cast("timestamp")).alias("d30"), F.count(F.lit(1)).alias("d90"))


@query("trend_measures", f"WITH {_COUNTS_SQL} SELECT user_id, event_type, d30, d90, round(trend_index, 9) AS trend_index, round(t, 9) AS trend_index_scaled, round(r, 9) AS d30_scaled, round(distance, 9) AS distance FROM m")
def measures(spark: SparkSession, d: str) -> DataFrame:
    out = trending.trend_measures(counts(spark, d), threshold=0.1)
    return out.select("user_id", "event_type", "d30", "d90", *[F.round(c, 9).alias(c) for c in ("trend_index", "trend_index_scaled", "d30_scaled", "distance")])


@query(
    "trend_ranking",
    f"WITH {_COUNTS_SQL}, q AS (SELECT user_id, event_type, round(distance, 9) AS distance FROM m), x AS (SELECT user_id, event_type, round(max(value), 4) AS best FROM events WHERE value > 10 GROUP BY 1, 2) SELECT q.user_id, q.event_type, distance, best, row_number() OVER (ORDER BY distance, q.user_id, q.event_type) AS rank FROM q LEFT JOIN x ON q.user_id = x.user_id AND q.event_type = x.event_type",
)
def trend_rank(spark: SparkSession, d: str) -> DataFrame:
    m = trending.trend_measures(counts(spark, d), threshold=0.1).select("user_id", "event_type", F.round("distance", 9).alias("distance"))
    best = table(spark, d, "events").filter("value > 10").groupBy("user_id", "event_type").agg(F.round(F.max("value"), 4).alias("best"))
    return trending.ranking(m, best, ["user_id", "event_type"]).select("user_id", "event_type", "distance", "best", F.col("rank").cast("long").alias("rank"))


@query(
    "trend_install_events",
    "SELECT CAST(user_id AS VARCHAR) AS name, CASE WHEN event_id % 2 = 0 THEN 'd30' ELSE 'd90' END AS window, CAST(1000 * (event_id % 9000) + 5 AS INTEGER) AS installs FROM events",
)
def installs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    count = F.format_number(1000 * (e % 9000) + 5, 0)
    body = F.concat(F.lit('{"k":[{"formula":"'), F.col("user_id").cast("string"), F.lit('","count":"'), count, F.lit('"}]}'))
    files = table(spark, d, "events").select(body.alias("formulae"), F.when(e % 2 == 0, "x/30d.json").otherwise("x/90d.json").alias("path"))
    return trending.install_events(files).select("name", "window", "installs")
