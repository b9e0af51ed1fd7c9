"""Sinks: sorted Parquet exports with metadata, sorted CSV lines, partitioned folders, receipts, external tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.session import fresh_path, written
from tesserae.sources.readers import file_manifest, file_system, row_groups


def with_metadata(df: DataFrame, metadata: Mapping[str, str]) -> DataFrame:
    """Key/value metadata, by sorted key, on the first column, where Parquet's footer carries it; none when empty."""
    first = df.columns[0]
    return df.withMetadata(first, {k: metadata[k] for k in sorted(metadata)}) if metadata else df


def export_parquet(
    df: DataFrame, dest: str, order_by: Sequence[str], compression: str = "zstd", block_bytes: int | None = None, metadata: Mapping[str, str] | None = None, single_file: bool = False, row_group_rows: int | None = None
) -> None:
    """Write df sorted by order_by over its files, nulls last; give a total order for the same rows in the same places.

    Row groups end at block_bytes, or at row_group_rows rows, whichever comes first.
    """
    order = [F.col(c).asc_nulls_last() for c in order_by]
    out = with_metadata(df, metadata or {})
    parts = 1 if single_file else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    grouped(out.write.mode("overwrite").option("compression", compression), block_bytes, row_group_rows).parquet(dest)


def grouped(writer: DataFrameWriter, block_bytes: int | None = None, row_group_rows: int | None = None) -> DataFrameWriter:
    """A Parquet writer whose row groups have at most so many bytes, and so many rows."""
    if row_group_rows is not None and row_group_rows < 1:
        raise ValueError("row_group_rows must be 1 or more")
    for option, value in (("parquet.block.size", block_bytes), ("parquet.block.row.count.limit", row_group_rows)):
        writer = writer.option(option, value) if value else writer
    return writer


def csv_line(df: DataFrame, into: str = "line") -> DataFrame:
    """One line of CSV for each row: texts always quoted, a null is nothing."""
    cells = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else value
        cells.append(F.coalesce(quoted, F.lit("")))
    return df.select("*", F.concat_ws(",", *cells).alias(into))


def write_csv_lines(df: DataFrame, dest: str, order_by: Sequence[str]) -> None:
    order = [F.col(c).asc_nulls_last() for c in order_by]
    csv_line(df).orderBy(*order).select("line").write.mode("overwrite").text(dest)


def write_json_arrays(df: DataFrame, dest: str, max_rows: int = 8_192) -> None:
    """JSON files of one array each, of at most max_rows rows (taken down to a power of two), from rows of one partition."""
    if max_rows < 1:
        raise ValueError("max_rows must be 1 or more")
    # the numbers of a partition's rows follow each other
    some = F.shiftright(F.monotonically_increasing_id(), max_rows.bit_length() - 1)
    arrays = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), some.alias("_some")).groupBy("_some").agg(F.to_json(F.collect_list("_row")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(dest)


def write_partitioned(df: DataFrame, dest: str, by: Sequence[str], max_rows: int | None = None, row_group_rows: int | None = None) -> None:
    """A folder for each value of `by`, files split at max_rows; rows of a value may come from several tasks."""
    writer = grouped(df.write.mode("overwrite").partitionBy(*by), row_group_rows=row_group_rows)
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(dest)


#: How often write_sized deals the rows at most.
DEALS = 4


def write_sized(df: DataFrame, dest: str, target_bytes: int, by: Sequence[str] = (), sort: Sequence[str] = (), row_group_rows: int | None = None) -> DataFrame:
    """Parquet files of about target_bytes each, in a folder for each value of `by`: the plan (by, bytes, n_files) as it was made.

    The rows are written once to the shared folder, and the bytes that a row takes there are read from the footers;
    a value's share of them follows from the lengths of its rows as text. It gets bytes / target_bytes files, rounded,
    one at least and a file for each row at most, so that only values with less than a file's bytes have a smaller one;
    its rows are dealt to these evenly, each file by a task of its own. Rows take more bytes in small files than in
    large ones, so the footers of what was made are read: where a file has less than half the target or more than one
    and a half times it, its value gets the number of files that the bytes made call for, and all is dealt once more,
    up to DEALS times. `sort` orders the rows of each file. Null values have a folder too.
    """
    if target_bytes < 1:
        raise ValueError("target_bytes must be 1 or more")
    spark = df.sparkSession
    path = fresh_path(spark, "sized")
    df.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    measured = row_groups(spark, path).agg(F.sum("bytes")).first()[0] or 0
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    keys = rows.select(*[F.col(f"`{c}`") for c in by], width.alias("_w")).groupBy(*by).agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n"))
    keys = written(keys, "keys")  # a row for each folder
    total = keys.agg(F.sum("_w")).first()[0] or 1
    share = F.col("_w") * (measured / total)
    files_for = lambda size: F.greatest(F.lit(1), F.least(F.col("_n"), F.round(size / target_bytes))).cast("long")
    plan = keys.select(*by, "_n", share.cast("long").alias("bytes"), files_for(share).alias("n_files"))
    before = F.coalesce(F.sum("n_files").over(Window.orderBy(*by or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the stored rows have the same numbers in every attempt of a task
    numbered = rows.withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    for deal in range(DEALS):
        plan = written(plan.withColumn("_first", before), "plan")
        n_files = plan.agg(F.sum("n_files")).first()[0] or 1
        to = plan.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], "n_files", "_first")
        meet = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.lit(True))
        dealt = numbered.join(to, meet)
        dealt = dealt.withColumn("_file", (F.col("_first") + F.pmod("_at", F.col("n_files"))).cast("int")).select(*df.columns, "_file")
        dealt = dealt.repartitionById(int(n_files), F.col("_file")).drop("_file")
        dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*by, *sort)]) if sort else dealt
        writer = grouped(dealt.write.mode("overwrite").option("compression", "zstd"), row_group_rows=row_group_rows)
        (writer.partitionBy(*by) if by else writer).parquet(dest)
        if deal + 1 == DEALS:
            break
        # a file's name has the number of its task, which is that of the file in the plan
        made = row_groups(spark, dest).groupBy(F.regexp_extract("path", "/part-([0-9]+)-[^/]*$", 1).cast("long").alias("_file")).agg(F.sum("bytes").alias("_bytes"))
        facts = [F.sum("_bytes").alias("_made"), F.max("_bytes").alias("_most"), F.min("_bytes").alias("_least")]
        owned = plan.select("_first", F.explode(F.sequence("_first", F.col("_first") + F.col("n_files") - 1)).alias("_file"))
        found = owned.join(made, "_file").groupBy("_first").agg(*facts)
        off = (F.col("_most") > 1.5 * target_bytes) | ((F.col("_least") < 0.5 * target_bytes) & (F.col("n_files") > 1))
        after = plan.join(found, "_first", "left").withColumn("_off", F.coalesce(off, F.lit(False)))
        after = after.select(*by, "_n", F.coalesce("_made", "bytes").alias("bytes"), F.when(F.col("_off"), files_for(F.col("_made"))).otherwise(F.col("n_files")).alias("n_files"), F.col("n_files").alias("_had"))
        after = written(after, "plan")
        if after.filter("n_files != _had").isEmpty():
            break
        plan = after.drop("_had")
    return plan.select(*by, "bytes", "n_files")


def register_files(spark: SparkSession, name: str, location: str) -> DataFrame:
    """An external table over existing Parquet files, in place of one of that name."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=location, source="parquet")
    return spark.table(name)


def create_table(spark: SparkSession, name: str, rows: DataFrame, location: str) -> DataFrame:
    """A table from rows at a location, in place of one of that name."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows.write.option("path", location).saveAsTable(name)
    return spark.table(name)


def insert_rows(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Rows appended to a table, columns by name."""
    rows.select(*spark.table(name).columns).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def define_view(name: str, rows: DataFrame) -> DataFrame:
    """A view of the session over rows, in place of one of that name."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def receipt(spark: SparkSession, folder: str, as_of: str, prefix: str = "") -> DataFrame:
    """What a publication holds: (name, bytes, sha256, as_of, key) for each data file of a folder."""
    files = file_manifest(spark, folder).select("name", "bytes", "sha256")
    return files.withColumn("as_of", F.lit(as_of).cast("date")).withColumn("key", F.concat(F.lit(prefix), "sha256"))


def receipt_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict() for r in rows.orderBy("name").collect()], sort_keys=True, default=str)


def save_bytes(path: str, data: bytes) -> None:
    """Write one file from a task, to a local path or any that Arrow knows by its scheme."""
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(data)
