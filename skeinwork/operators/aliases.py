"""Aliases of tracks: which link counts, where chains of links end, and what caches teach.

``links``: of several targets of an alias the newest counts; if the newest are two, none does.  ``resolve``:
every key's end of its chain, by pointer jumping: in each round a key points where its target pointed, so a
chain of n links takes about log2(n) rounds, each one join and a table in the shared folder.  The least key
of a cycle sees itself among those it has jumped over after as many rounds; it then ends as
``cycle``, and so does everything that leads there.  Such keys, and aliases without one newest target, stay themselves.

Null keys are passed over; a link to itself is none; repeated links are one; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.runtime import discard, materialize

#: Newest cached rows of a family that may teach an alias (fixed value).
TAUGHT_BY = 3


def compatible(alias_artist: Column, alias_title: Column, artist: Column, title: Column) -> Column:
    """Whether a track may be another's alias: credits and titles agree."""
    return F.coalesce(text.credits_compatible(alias_artist, artist) & text.titles_compatible(alias_title, title), F.lit(False))


def links(aliases: DataFrame) -> DataFrame:
    """(alias, target, state) of rows (alias, target, at): ``link``, or ``conflict`` with no target."""
    known = aliases.filter("alias is not null and target is not null and alias <> target")
    newest = known.groupBy("alias").agg(F.max_by(F.struct("target"), F.struct(F.col("at").isNotNull(), "at")).alias("x"), F.max("at").alias("at"))
    tied = known.join(newest.select("alias", F.col("at").alias("last")), "alias").filter(F.col("at").eqNullSafe(F.col("last")))
    told = tied.groupBy("alias").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    sure = F.col("target") == F.col("other")
    return told.select("alias", F.when(sure, F.col("target")).alias("target"), F.when(sure, "link").otherwise("conflict").alias("state"))


def resolve(made: DataFrame) -> DataFrame:
    """(alias, canonical, state) of ``links``: ``resolved``, ``conflict`` or ``cycle``, the last two with themselves as canonical."""
    told = materialize(made, "links")
    now = told.filter("state = 'link'").select("alias", "target", F.col("target").alias("low"), F.lit(False).alias("ended"), F.lit(False).alias("cycle"))
    now = materialize(now, "jump")
    while not now.filter("not ended").isEmpty():
        ahead = now.select(F.col("alias").alias("target"), F.col("target").alias("next"), F.col("low").alias("next_low"), F.col("ended").alias("next_ended"), F.col("cycle").alias("next_cycle"))
        step = now.filter("not ended").join(ahead, "target", "left")
        low = F.least("low", "next_low")  # a missing one is passed over
        met = F.col("next_low").isNotNull() & ((low == F.col("alias")) | (F.col("next") == F.col("alias")))
        over = F.col("next").isNull() | met | F.col("next_ended")
        jumped = step.select("alias", F.coalesce("next", "target").alias("target"), low.alias("low"), over.alias("ended"), F.coalesce(met | F.col("next_cycle"), F.lit(False)).alias("cycle"))
        before, now = now, materialize(now.filter("ended").unionByName(jumped), "jump")
        discard(before)
    ends = now.select("alias", F.when(F.col("cycle"), F.col("alias")).otherwise(F.col("target")).alias("canonical"), F.when(F.col("cycle"), "cycle").otherwise("resolved").alias("state"))
    return ends.unionByName(told.filter("state = 'conflict'").select("alias", F.col("alias").alias("canonical"), "state"))


def family(key: Column) -> Column:
    """The artist and title of a longer key."""
    return F.substring_index(key, "|", 2)


def learn(tracks: DataFrame, cached: DataFrame) -> DataFrame:
    """(alias, target): what files teach of ``tracks`` (artist, title): of the ``TAUGHT_BY`` newest ``cached`` rows (track_key, performer, title, at) of
    a track's family, the newest that names a compatible artist and title, if they make another key."""
    asked = tracks.select(F.col("artist").alias("own_artist"), F.col("title").alias("own_title"), text.identity_key(F.col("artist"), F.col("title")).alias("alias")).filter("alias is not null").dropDuplicates(["alias"])
    recent = Window.partitionBy("alias").orderBy(F.desc_nulls_last("at"), "track_key")
    rows = cached.select(family(F.col("track_key")).alias("alias"), "track_key", "performer", "title", "at").withColumn("place", F.row_number().over(recent)).filter(F.col("place") <= TAUGHT_BY)
    met = rows.join(asked, "alias").filter(compatible(F.col("own_artist"), F.col("own_title"), F.col("performer"), F.col("title")))
    named = met.withColumn("target", text.identity_key(F.col("performer"), F.col("title"))).filter("target is not null and target <> alias")
    return named.groupBy("alias").agg(F.min_by("target", "place").alias("target"))
