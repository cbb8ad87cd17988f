"""Newline-delimited JSON, plain or gzipped, with manifests that tell what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of a schema; a line that is not JSON fails the load.  A gzip file is one split, so deal rows out."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.repartition(partitions) if partitions else rows


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of all lines, counted from 1 in each file.

    A large plain file is read in splits; a line's number is its place in its split after the lines of the splits
    before it.  Only one row per split is shuffled, and no row is larger than a line.  Empty files have no lines.
    """
    source = F.col("_metadata")
    lines = spark.read.text(path).select("value", source["file_path"].alias("path"), source["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("path", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["path", "split"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), F.rtrim("value", F.lit("\r")).alias("text"))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, text) of the lines that do not parse; lines are counted from 1 in each file, blank ones too."""
    lines = numbered(spark, path).filter(F.trim("text") != "")
    parsed = F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return lines.filter(parsed["_bad"].isNotNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files; a file whose name ends in .gz must begin as gzip does."""
    files = spark.read.format("binaryFile").load(path)
    is_gzip = F.hex(F.substring("content", 1, 2)) == "1F8B"
    checked = F.when(~F.col("path").endswith(".gz") | is_gzip, F.sha2("content", 256)).otherwise(F.raise_error(F.concat(F.lit("not gzip: "), "path")))
    return files.select("path", checked.alias("sha256"), F.col("length").alias("bytes"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of a manifest that an earlier one lacks or has with other content."""
    return now.join(before, ["path", "sha256"], "left_anti")


def rowset(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The elements of a JSON array column as rows of a schema."""
    return rows.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))
