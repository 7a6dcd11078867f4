"""Keyset paging: rows clustered by their order, so that any page is read from the files that hold it.

Rows lie in files by ranges of the order, newest first, each file sorted. A small manifest has each file's number of rows
and first key. A page is sought by the key after which it starts, or by its number through the manifest's running counts;
either way the rows read are those of one page and of the files at its ends, however far down the page is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


FILES_A_TASK = 100


def write_pages(rows: DataFrame, path: str, date: str = "date", id_col: str = "id", per_file: int = 100_000) -> None:
    """Write rows by date, latest first (null last), then id; the pair (date, id) must tell rows apart."""
    files = max(1, -(-rows.count() // per_file))
    # A task writes up to FILES_A_TASK files one after the other, so that what tasks tell the driver doesn't grow with the files.
    tasks = min(files, max(rows.sparkSession.sparkContext.defaultParallelism, -(-files // FILES_A_TASK)))
    order = [F.desc_nulls_last(date), F.asc_nulls_first(id_col)]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    key = F.struct(F.col(date).alias("date"), F.col(id_col).alias("id"))
    ends = stored.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.max_by(key, sort_key(date, id_col)).alias("first"))
    in_order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("first.date"), F.asc_nulls_first("first.id"))  # a row a file
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends.select("file", "n", before.alias("before"), "first").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def sort_key(date: str, id_col: str) -> Column:
    """A value that is greater the earlier a row stands."""
    return F.struct(F.col(date).isNotNull(), F.col(date), F.col(id_col).isNull(), -F.col(id_col))


def manifest(spark: SparkSession, path: str) -> list:
    return sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r["before"])


def files_at(spark: SparkSession, path: str, low: int, size: int) -> list:
    """The manifest's rows of the files that hold the places from low on, so many; no others leave the executors."""
    held = spark.read.parquet(f"{path}/manifest").where((F.col("before") < low + size) & (F.col("before") + F.col("n") > low))
    return sorted(held.collect(), key=lambda r: r["before"])


def read_files(spark: SparkSession, schema, files: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def page_at(spark: SparkSession, path: str, schema, number: int, size: int = 20, date: str = "date", id_col: str = "id") -> DataFrame:
    """The rows of page `number`, from 0, with their place in the whole order."""
    low = number * size
    held = files_at(spark, path, low, size)
    rows = read_files(spark, schema, [r["file"] for r in held])
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(date), F.asc_nulls_first(id_col))  # rows of a page's files
    place = F.lit(held[0]["before"] if held else 0) + F.row_number().over(order) - 1
    return rows.withColumn("place", place).where((F.col("place") >= low) & (F.col("place") < low + size))


def page_after(spark: SparkSession, path: str, schema, after: tuple | None, size: int = 20, date: str = "date", id_col: str = "id") -> DataFrame:
    """The first rows after the key (date, id) of the last row seen; from the start if there is none."""
    low = ahead = 0
    if after is not None:
        then = F.struct(F.lit(after[0] is not None), F.lit(after[0]).cast(schema[date].dataType), F.lit(after[1] is None), -F.lit(after[1]).cast(schema[id_col].dataType))
        begun = spark.read.parquet(f"{path}/manifest").where(sort_key("first.date", "first.id") >= then)
        last = begun.agg(F.max_by(F.struct("before", "n"), "before").alias("at")).first()["at"]  # the file that holds the key, or its end
        low = last["before"] if last else 0
        ahead = last["n"] if last else 0
    # Of the first file any number of rows may be behind, so the files after it must hold a page of their own.
    held = [r["file"] for r in files_at(spark, path, low, size + ahead)]
    rows = read_files(spark, schema, held)
    if after is not None:
        rows = rows.where(sort_key(date, id_col) < then)
    return rows.orderBy(F.desc_nulls_last(date), F.asc_nulls_first(id_col)).limit(size)
