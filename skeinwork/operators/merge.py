"""Write semantics over versioned tables: every operator returns the table's next version.

Parquet tables take no UPDATE or MERGE, so a batch is joined to the table by key (one shuffle a
side) and each column follows a rule.  A batch must have one row a key; ``latest`` makes it so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (old, new) -> merged, for a key that both sides have.
Rule = Callable[[Column, Column], Column]


def new(old: Column, new: Column) -> Column:
    return new


def old(old: Column, new: Column) -> Column:
    return old


def new_else_old(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def old_else_new(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def least(old: Column, new: Column) -> Column:
    return F.least(old, new)


def when_known(unknown: str = "unknown") -> Rule:
    """The new value unless it is null or ``unknown``."""
    return lambda old, new: F.when(new.isNotNull() & (new != unknown), new).otherwise(old)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule], guard: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """Insert rows of new keys; merge the others by ``rules`` (columns without a rule take the new value).

    ``guard``: given both sides, whether a row that both have is merged at all.
    """
    e = existing.withColumn("_e", F.lit(True)).alias("e")
    i = incoming.withColumn("_i", F.lit(True)).alias("i")
    joined = e.join(i, [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], "full_outer")
    has_old, has_new = F.col("e._e").isNotNull(), F.col("i._i").isNotNull()
    allowed = guard(e, i) if guard else F.lit(True)
    out = []
    for c in existing.columns:
        before, after = F.col(f"e.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        merged = F.when(has_old, before).otherwise(after) if c in keys else rules.get(c, new)(before, after)
        out.append(F.when(~has_new, before).when(~has_old, after).when(F.coalesce(allowed, F.lit(False)), merged).otherwise(before).alias(c))
    return joined.select(*out)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys are added, others ignored."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def replace_lists(existing: DataFrame, incoming: DataFrame, owner: list[str]) -> DataFrame:
    """The lists of owners in ``incoming`` give way to its rows."""
    return existing.join(incoming.select(*owner).distinct(), owner, "left_anti").unionByName(incoming)


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that an odd number of toggles has left on."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").drop("_n")


def supersede(rows: DataFrame, family: list[str], *order: Column) -> DataFrame:
    """Add ``active`` and ``superseded_by`` (the ``key`` of the family's first row in ``order``)."""
    w = Window.partitionBy(*family).orderBy(*order)
    first, rank = F.first("key").over(w), F.row_number().over(w)
    return rows.withColumn("active", rank == 1).withColumn("superseded_by", F.when(rank > 1, first))


def delete_cascade(parent: DataFrame, child: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Parent rows that stay, and the child rows that still have a parent."""
    stay = parent.filter(~F.coalesce(gone, F.lit(False)))
    return stay, child.join(stay.select(key), key, "left_semi")


def add_columns(table: DataFrame, other: DataFrame) -> DataFrame:
    """Additive migration: the union with nulls where a side lacks a column."""
    return table.unionByName(other, allowMissingColumns=True)
