"""Joins and names that a frequent key cannot pull into one task.

``look_up``: the most frequent keys of the rows find their partner by broadcast, of which there are
``FREQUENT`` at most whatever the input; all others by shuffle, where none has more than one row in
``FREQUENT`` of all.  ``dense_names``: numbers 0, 1, ... for the distinct keys of rows, equal keys
equal numbers; keys are compared themselves, not by hashes.

Rows are read a few times, so they should come from a written table.  Keys must not be null.  Repeated rows are kept each; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.runtime import materialize

#: Keys looked up by broadcast at most, and rows of a key that are worth it.
FREQUENT, WORTH = 256, 1000


def look_up(rows: DataFrame, table: DataFrame, on: list[str], outer: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once; without those that have none unless ``outer``."""
    often = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= WORTH).orderBy(F.desc("_n"), *on).limit(FREQUENT).drop("_n")
    known = table.join(F.broadcast(often), on).withColumn("_often", F.lit(True))
    tried = rows.join(F.broadcast(known), on, "left")
    rest = tried.filter("_often is null").select(*rows.columns).join(table, on, "left" if outer else "inner")
    columns = [*rows.columns, *(c for c in table.columns if c not in on)]
    return tried.filter("_often").select(*columns).unionByName(rest.select(*columns))


def dense_names(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: the number of their ``keys``."""
    listed = materialize(rows.select(*keys).distinct().withColumn("_at", F.monotonically_increasing_id()), f"names-{name}")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = listed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    named = listed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*keys, (F.col("_start") + within).alias(name))
    return look_up(rows, named, keys)
