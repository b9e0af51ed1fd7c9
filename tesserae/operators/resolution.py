"""Entity resolution by name: normalise, block, compare, weigh, rank."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import jaro_winkler
from tesserae.operators.joins import block_pairs
from tesserae.session import written
from tesserae.sources.sinks import export_parquet

# Company suffixes that a normalised name loses one of.
SUFFIXES = "CORPORATION CORP INCORPORATED INC COMPANY CO LIMITED LTD LLC PLC LP HOLDINGS GROUP".split()
# First words too frequent to block on.
STOPWORDS = "THE STICHTING SOCIETE STIFTUNG FONDATION ASSOCIATION FUNDACION FONDAZIONE".split()
# Statuses of a register in order of trust.
STATUSES = ["ISSUED", "LAPSED", "RETIRED"]
# Least similarity of each level, and the probabilities of that level among matches (m) and others (u).
LEVELS = [(1.0, 0.80, 1e-6), (0.95, 0.12, 1e-5), (0.92, 0.04, 1e-4), (0.88, 0.02, 1e-3), (0.0, 0.02, 0.998889)]
RULES = [["country", "blk_p6"], ["blk_p8"], ["country", "blk_tok"], ["blk_exact"]]


@dataclass(frozen=True)
class ResolveConfig:
    """Options of resolve(); unknown ones are refused."""

    rules: Sequence[Sequence[str]] = field(default_factory=lambda: RULES)
    prior: float = 0.01
    keep_from: float = 0.30
    left_country: str = "US"
    home: str = "US"
    hot_block: int | None = 20_000  # names of a block from which on it is dealt over several tasks; None: never

    @classmethod
    def of(cls, **options) -> ResolveConfig:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(options) - known):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**options)


def normalize_name(col: Column) -> Column:
    """Upper-case letters, digits and single spaces, without one trailing company suffix; null is empty."""
    up = F.upper(F.replace(F.coalesce(col, F.lit("")), F.lit("ß"), F.lit(" ")))
    words = F.regexp_replace(up, "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(words, rf" (?:{'|'.join(SUFFIXES)}) ?\z", ""))


def blocking_keys(df: DataFrame, name: str) -> DataFrame:
    """Blocking keys of a normalised name, each null where the name is too short for it.

    `core` is the name without one leading stopword; keys are its first 6 and 8 characters, its first
    word of 4 or more, and itself.
    """
    first = F.split_part(name, F.lit(" "), F.lit(1))
    core = F.when(first.isin(STOPWORDS), F.substr(F.col(name), F.length(first) + 2)).otherwise(F.col(name))
    out = df.withColumn("core", core)
    word = F.split_part("core", F.lit(" "), F.lit(1))
    n = F.length("core")
    return out.withColumns(
        {
            "blk_p6": F.when(n >= 6, F.substring("core", 1, 6)),
            "blk_p8": F.when(n >= 8, F.substring("core", 1, 8)),
            "blk_tok": F.when(F.length(word) >= 4, word),
            "blk_exact": F.when(n >= 2, F.col("core")),
        }
    )


def level_of(similarity: Column) -> Column:
    """The level of a similarity, 0 for equal names."""
    out = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        out = F.when(similarity >= LEVELS[k][0], k).otherwise(out)
    return F.when(similarity.isNotNull(), out)


def fs_weight(level: Column, prior: float = 0.01) -> Column:
    """Fellegi-Sunter match weight of a level: log2 of the prior odds times m / u; a null level adds nothing."""
    odds = F.lit(prior / (1 - prior))
    bayes = F.lit(1.0)
    for k, (_, m, u) in enumerate(LEVELS):
        bayes = F.when(level == k, m / u).otherwise(bayes)
    return F.log2(odds * bayes)


def fs_probability(weight: Column) -> Column:
    return F.pow(F.lit(2.0), weight) / (1 + F.pow(F.lit(2.0), weight))


def compare(pairs: DataFrame, left: str, right: str, least: float = 0.92) -> DataFrame:
    """pairs with `similarity`, null where it is certainly under `least`.

    Equal names need no comparing, and names whose lengths differ too much cannot reach `least`. The
    others are compared once for each distinct pair of names, in Arrow batches.
    """
    l, r = F.col(left), F.col(right)
    short, long = F.least(F.length(l), F.length(r)), F.greatest(F.length(l), F.length(r))
    # jaro <= (2 + short / long) / 3 and the prefix adds at most 0.4 of the rest
    can = (0.6 * (2 + short / long) / 3 + 0.4) >= least
    todo = pairs.filter((l != r) & can).select(left, right).distinct()
    done = todo.withColumn("_jw", jaro_winkler(F.col(left), F.col(right)))
    return pairs.join(done, [left, right], "left").withColumn("similarity", F.when(l == r, 1.0).otherwise(F.col("_jw"))).drop("_jw")


def score_pairs(left: DataFrame, right: DataFrame, cfg: ResolveConfig) -> DataFrame:
    """Candidate pairs with their match weight and probability, from cfg.keep_from on.

    left has uid, nname; right has uid, nname, country; both may have more. Pairs are formed between
    distinct names (and countries), and rows are put back afterwards, so that a name that many rows
    share is blocked and compared once.
    """
    l_names = blocking_keys(left.select("nname", F.lit(cfg.left_country).alias("country")).distinct(), "nname")
    r_names = blocking_keys(right.select("nname", "country").distinct(), "nname")
    # distinct names and candidate pairs are used several times below
    l_names = written(l_names.withColumn("key", F.col("nname")), "names")
    r_names = written(r_names.withColumn("key", F.struct("nname", "country")), "names")
    pairs = block_pairs(l_names, r_names, cfg.rules, "key", "key", cfg.hot_block)
    pairs = written(pairs.select(F.col("l_id").alias("l_nname"), F.col("r_id.nname").alias("r_nname"), F.col("r_id.country").alias("r_country")), "pairs")
    scored = compare(pairs, "l_nname", "r_nname").filter("similarity IS NOT NULL")
    scored = scored.withColumn("match_weight", fs_weight(level_of(F.col("similarity")), cfg.prior))
    scored = scored.withColumn("match_probability", fs_probability(F.col("match_weight"))).filter(F.col("match_probability") >= cfg.keep_from)
    on_left = scored.join(left.select(F.col("uid").alias("l_uid"), F.col("nname").alias("l_nname")), "l_nname")
    r = right.select(F.col("uid").alias("r_uid"), F.col("nname").alias("r_nname"), F.col("country").alias("_c"))
    joined = on_left.join(r, "r_nname").filter(F.col("r_country").eqNullSafe(F.col("_c")))
    return joined.select("l_uid", "r_uid", "l_nname", "r_nname", "match_weight", "match_probability")


def rank_edges(scored: DataFrame, right: DataFrame, home: str = "US") -> DataFrame:
    """The best edge of each left row, by probability, register status, home jurisdiction and id, with method and status.

    right has uid, legal_name, jurisdiction, reg_status. An exact name is confirmed, or ambiguous where
    several register rows are equally good; any other name is a candidate.
    """
    info = right.select(F.col("uid").alias("r_uid"), "legal_name", "jurisdiction", "reg_status")
    trust = F.coalesce(*[F.when(F.col("reg_status") == s, k) for k, s in enumerate(STATUSES)], F.lit(len(STATUSES)))
    rows = scored.join(info, "r_uid").withColumns({"_trust": trust, "_home": F.coalesce(F.startswith("jurisdiction", F.lit(home)), F.lit(False))})
    tier = Window.partitionBy("l_uid", "match_probability", "_trust", "_home")
    order = Window.partitionBy("l_uid").orderBy(F.col("match_probability").desc(), "_trust", F.col("_home").desc(), "r_uid")
    rows = rows.withColumn("_same", F.count(F.lit(1)).over(tier)).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    exact = F.col("l_nname") == F.col("r_nname")
    return rows.select(
        "l_uid",
        "r_uid",
        "legal_name",
        "jurisdiction",
        "reg_status",
        "match_weight",
        "match_probability",
        F.when(exact, "exact_name").otherwise("jaro_winkler").alias("method"),
        F.when(exact & (F.col("_same") > 1), "ambiguous").when(exact, "confirmed").otherwise("candidate").alias("status"),
    )


def resolve(left: DataFrame, right: DataFrame, cfg: ResolveConfig | None = None) -> DataFrame:
    """Which register row each left name is, and how sure: left's columns and those of rank_edges.

    left: uid, name, …; right: uid, legal_name, jurisdiction, country, reg_status. Rows without a name,
    and register rows of other statuses than STATUSES, take no part.
    """
    cfg = cfg or ResolveConfig()
    l = left.withColumn("nname", normalize_name(F.col("name"))).filter("nname != ''")
    r = right.withColumn("nname", normalize_name(F.col("legal_name"))).filter("nname != ''").filter(F.col("reg_status").isin(STATUSES))
    edges = rank_edges(score_pairs(l, r, cfg), r, cfg.home)
    return left.withColumnRenamed("uid", "l_uid").join(edges, "l_uid")


def coverage(edges: DataFrame, left: DataFrame) -> DataFrame:
    """Edges by status: n, pct of left rows, avg_p, exact, fuzzy."""
    total = left.agg(F.count(F.lit(1)).alias("_total"))
    by = edges.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("match_probability"), 3).alias("avg_p"),
        F.count_if(F.col("method") == "exact_name").alias("exact"),
        F.count_if(F.col("method") == "jaro_winkler").alias("fuzzy"),
    )
    return by.crossJoin(F.broadcast(total)).select("status", "n", F.round(100.0 * F.col("n") / F.col("_total"), 1).alias("pct"), "avg_p", "exact", "fuzzy")  # one row


def export(edges: DataFrame, dest: str, key: str = "l_uid") -> None:
    """Write the edges as Parquet in an order that is the same for the same edges: by left row, then register row."""
    export_parquet(edges, dest, [key, "r_uid"])


def spot_check(edges: DataFrame, ids: DataFrame, col: str = "l_uid") -> DataFrame:
    """The edges of a short list of ids."""
    return edges.join(ids, col, "left_semi")
