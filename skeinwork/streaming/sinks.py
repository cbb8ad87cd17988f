"""Stream sinks in the shared folder: appended files, and a keyed table whose upserts can be replayed.

The keyed table is kept in buckets of its keys' hash.  A micro-batch rewrites the buckets it touches, each under
the batch's own number, from that bucket's newest earlier number; readers take the newest number of every
bucket.  A batch that is run again therefore writes the same rows to the same place.  ``vacuum`` deletes what no
reader and no replay of the last batch needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.runtime import shared_dir
from skeinwork.streaming.ordered import PROVIDER, ROCKS


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as timers and typed state need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain(stream: DataFrame, label: str, checkpoint: str | None = None) -> DataFrame:
    """Run an appending stream over what there is now, into files of the shared folder, and read them."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with rocks(spark):
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint or f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The keyed table at ``path`` as of batch numbers below ``before``; None without any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # partition values only
    return rows.join(F.broadcast(last), ["bucket", "batch"]).drop("batch")


def upserting(path: str, keys: list[str], order: Column, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: of each key the row that is last in ``order`` stays, those of equal order by their content."""

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        old = newest(spark, path, number)
        if old is not None:
            touched = rows.select("bucket").distinct()  # ``buckets`` rows at most
            rows = rows.unionByName(old.join(F.broadcast(touched), "bucket", "left_semi").select(*rows.columns))
        others = [c for c in rows.columns if c not in (*keys, "bucket")]
        rank = F.struct(order, *others) if others else F.struct(order)
        best = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*others, F.lit(0).alias("_")), rank).alias("_row"))
        best = best.select("bucket", *keys, *(F.col("_row").getField(c).alias(c) for c in others), F.lit(number).alias("batch"))
        best.write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return write


def vacuum(spark: SparkSession, path: str, keep: int) -> int:
    """Delete what batch ``keep`` and later ones have superseded and their replay does not read; how many folders went."""
    rows = spark.read.parquet(path).select("bucket", "batch").distinct().filter(F.col("batch") < keep)
    old = rows.join(rows.groupBy("bucket").agg(F.max("batch").alias("_last")), "bucket").filter("batch < _last").collect()  # buckets times batches
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in old:
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r.bucket}/batch={r.batch}")
        where.getFileSystem(conf).delete(where, True)
    return len(old)


def drain_upserts(stream: DataFrame, label: str, keys: list[str], order: Column) -> DataFrame:
    """Run a stream over what there is now, into a keyed table of the shared folder, and read it."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(upserting(f"{path}/rows", keys, order)).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    made = newest(spark, f"{path}/rows")
    return spark.createDataFrame([], stream.schema) if made is None else made.select(*stream.columns)
