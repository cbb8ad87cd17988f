"""Session helpers: table loading and intermediate tables in the shared folder.

Intermediates go to the folder that the session names in ``spark.checkpoint.dir``;
executors may be lost at any time, so nothing is ever kept on one machine only.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no shared folder (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/skeinwork"

_WRITTEN: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash.

    A session on a real cluster must name one; a local session gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_CHECKPOINTS


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, in the shared folder and read it back (lineage ends there)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append((label, path))
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; for small tables, freed when unreferenced."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more, now and not at its next sweep."""
    gc.collect()
    spark._jvm.System.gc()


def written() -> int:
    """How many tables ``materialize`` has written and ``release`` has not deleted."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote, from number ``since`` on, all but the last ``keep``.

    Call it only when every result that reads them has been written elsewhere.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN) - keep > since:
        _, path = _WRITTEN.pop(since)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialize`` gave as ``df``, which nothing will read again."""
    read = df.inputFiles()[:1]
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for entry in [x for x in _WRITTEN if any(x[1].rsplit("/", 1)[-1] in f for f in read)]:
        _WRITTEN.remove(entry)
        where = jvm.org.apache.hadoop.fs.Path(entry[1])
        where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
