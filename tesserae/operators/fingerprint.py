"""Fingerprints of tables, change detection between snapshots, debouncing and content-addressed de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(cols: Sequence[str]) -> Column:
    """sha256 of a row's values by column name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


#: Rows that a bucket of a digest tree has about, at most.
BUCKET_ROWS = 4096


def digest_buckets(df: DataFrame, digits: int) -> DataFrame:
    """The leaves of a digest tree: (bucket, n_rows, digest) for each prefix of so many hexadecimal digits that a row's digest has.

    Equal rows are counted before the shuffle, so they are one entry. A bucket's digest is that of its rows' digests
    and counts in order.
    """
    rows = df.select(row_digest(df.columns).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.concat_ws(":", "_d", F.col("_n").cast("string"))))
    return rows.groupBy(F.substring("_d", 1, digits).alias("bucket")).agg(F.sum("_n").alias("n_rows"), F.sha2(F.array_join(entries, ","), 256).alias("digest"))


def tree_digits(n_rows: int) -> int:
    """Digits of the leaves' prefixes for so many rows: 0, 2, 4, …, so that a leaf has about BUCKET_ROWS rows at most."""
    digits = 0
    while n_rows > BUCKET_ROWS * 16**digits:
        digits += 2
    return digits


def table_fingerprint(df: DataFrame, digits: int | None = None) -> DataFrame:
    """(n_rows, fingerprint), the same for any order and layout of the same rows, repeated ones counted.

    Rows are hashed with sha256 into the leaves of a tree (digest_buckets), and 256 nodes at a time into one, up to the
    root; the number of rows and the root give the fingerprint. No node has more than some thousand entries. digits
    follows from the number of rows where it isn't given; tables to be compared by differing_buckets take the same.
    An empty table has one too.
    """
    if digits is None:
        digits = tree_digits(df.count())
    if digits % 2:
        raise ValueError("digits must be even")
    nodes = digest_buckets(df, digits)
    while digits:
        digits -= 2
        entries = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest")))
        nodes = nodes.groupBy(F.substring("bucket", 1, digits).alias("bucket")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(entries, ","), 256).alias("digest"))
    one = nodes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("digest"), F.lit("")).alias("_root"))  # the root alone
    return one.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), "_root"), 256).alias("fingerprint"))


def differing_buckets(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """Leaves in which two tables differ: (bucket, n_a, n_b); rows whose digest begins otherwise are the same in both."""
    x = digest_buckets(a, digits).select("bucket", F.col("n_rows").alias("n_a"), F.col("digest").alias("_da"))
    y = digest_buckets(b, digits).select("bucket", F.col("n_rows").alias("n_b"), F.col("digest").alias("_db"))
    both = x.join(y, "bucket", "full").filter(~F.col("_da").eqNullSafe(F.col("_db")))
    return both.select("bucket", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def differing_rows(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """Rows that one table has more often than the other: its columns, n_a and n_b. Only rows of differing buckets are compared."""
    buckets = differing_buckets(a, b, digits).select("bucket")
    b = b.select(*a.columns)

    def counted(df: DataFrame, into: str) -> DataFrame:
        rows = df.withColumn("_d", row_digest(df.columns)).withColumn("bucket", F.substring("_d", 1, digits)).join(buckets, "bucket", "left_semi")
        return rows.groupBy("_d").agg(F.count(F.lit(1)).alias(into), F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(f"_{into}"))

    both = counted(a, "n_a").join(counted(b, "n_b"), "_d", "full").filter(~F.col("n_a").eqNullSafe(F.col("n_b")))
    row = F.coalesce("_n_a", "_n_b")
    return both.select(row.alias("_row"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).select("_row.*", "n_a", "n_b")


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, bytes, sha256): added, removed, modified or same. An unknown digest is modified."""
    c = current.select("path", F.col("bytes").alias("_cb"), F.col("sha256").alias("_cs"), F.lit(True).alias("_c"))
    p = previous.select("path", F.col("bytes").alias("_pb"), F.col("sha256").alias("_ps"), F.lit(True).alias("_p"))
    same = F.coalesce((F.col("_cs") == F.col("_ps")) & (F.col("_cb") == F.col("_pb")), F.lit(False))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(same, "same").otherwise("modified")
    return c.join(p, "path", "full").select("path", change.alias("change"))


def snapshot_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose row was added, removed or modified between two snapshots: the keys and change."""
    rest = [c for c in current.columns if c not in keys]
    c = current.select(*keys, row_digest(rest).alias("_c"))
    p = previous.select(*keys, row_digest(rest).alias("_p"))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_c") != F.col("_p"), "modified")
    return c.join(p, list(keys), "full").withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def dataset_fingerprint(manifest: DataFrame) -> DataFrame:
    """Fingerprint of a manifest's (path, sha256): renaming a file changes it."""
    return table_fingerprint(manifest.select("path", "sha256"))


def content_addressed(df: DataFrame, locator: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Objects (sha256, bytes, n_locators), one for each content, and locators (locator, sha256)."""
    rows = df.select(F.col(locator).alias("locator"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).alias("bytes"))
    objects = rows.groupBy("sha256").agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_locators"))
    return objects, rows.select("locator", "sha256")


def verified_content(df: DataFrame, locator: str, content: str, declared: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """content_addressed of the rows whose declared digest is that of their content, and the rows refused.

    refused: (locator, declared, sha256, reason): `blank` where no digest is declared, `malformed` where it is no 64
    hexadecimal digits, `no content`, `mismatch` where the content has another one. A declared digest may be in upper
    case. A locator is refused row by row, and none of its content gets an object by a refused row.
    """
    said = F.lower(F.trim(F.col(declared)))
    actual = F.sha2(F.col(content).cast("binary"), 256)
    reason = (
        F.when(F.coalesce(said, F.lit("")) == "", "blank").when(~valid_digest(said), "malformed").when(actual.isNull(), "no content").when(said != actual, "mismatch")
    )
    rows = df.withColumn("_reason", reason)
    objects, locators = content_addressed(rows.filter(F.col("_reason").isNull()), locator, content)
    refused = rows.filter(F.col("_reason").isNotNull()).select(F.col(locator).alias("locator"), F.col(declared).alias("declared"), actual.alias("sha256"), F.col("_reason").alias("reason"))
    return objects, locators, refused


def valid_digest(col: Column) -> Column:
    """Whether a digest is 64 lowercase hex digits; null and blank are not."""
    return F.coalesce(col.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def debounce(df: DataFrame, key: str, ts: str, state: str, kind: str, gap_seconds: float = 10, saves: str = "save", tie: str | None = None) -> DataFrame:
    """A change log without repeats and with bursts of saves collapsed to their newest row.

    A row whose state is that of the key's row before goes. Of what is left, consecutive rows of kind
    `saves` at most gap_seconds apart are one run, of which the last row stays; rows of other kinds
    break runs and all stay. Order is by ts and tie; one shuffle by key.
    """
    order = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in (ts, tie) if c])
    rows = df.withColumn("_ps", F.lag(state).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    rows = rows.filter(F.col("_first") | ~F.col(state).eqNullSafe(F.col("_ps")))
    secs = lambda c: F.col(c).cast("timestamp").cast("double")
    rows = rows.withColumn("_pk", F.lag(kind).over(order)).withColumn("_gap", secs(ts) - F.lag(secs(ts)).over(order))
    goes_on = (F.col(kind) == saves) & (F.col("_pk") == saves) & (F.col("_gap") <= gap_seconds)
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy(key, "_run").orderBy(*[F.col(c).desc_nulls_last() for c in (ts, tie) if c])
    return rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_ps", "_first", "_pk", "_gap", "_run", "_rn")
