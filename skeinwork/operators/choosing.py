"""Choosing one row of a list for a request, or none where the rows do not say which.

``shortcuts`` finds the artist that a list of search results speaks of, ``pickers`` the entry of a choice that
names the asked artist, ``refinements`` the button that narrows a search down.  Rows are first folded to one row for
each name of a list, so that a list of any length is counted before it is shuffled; what is left of a list
meets its request once, and the choice is an aggregate of tiers, never a sorted group in one task's memory.

Edge cases: rows without a list or a place and blank names say nothing; a list with several requests takes the
smallest; null requests are blank; a request without rows chooses nothing and is returned with nulls; among rows of
equal rank the first place wins, then the smallest name; extra columns are ignored; no requests give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import parsers, text
from skeinwork.operators import search

# Rows that a name needs to stand for a list; points of a button.
SUPPORT = 2
SHARED, SAME, WITHIN, SONG = 20, 80, 35, 8
#: What a button begins with that leads to an artist.
SPEAKERS = "🗣🎤🎙"


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def album_intent(query: Column) -> Column:
    """Whether a query asks for an album."""
    return F.exists(_words(text.norm(query)), lambda x: x.isin(*text.ALBUM_WORDS))


def asks_for(query: Column, artist: Column) -> Column:
    """Whether all meaningful words of a query are words of the artist's name; a blank query asks for any."""
    wanted, have = search.meaningful(query), _words(text.norm(artist))
    named = (F.size(wanted) > 0) & (F.size(have) > 0) & (F.size(F.array_except(wanted, have)) == 0)
    return (text.clean(query) == "") | named


def _requests(rows: DataFrame, what: str) -> DataFrame:
    return rows.filter("session is not null").groupBy("session").agg(F.min(F.coalesce(what, F.lit(""))).alias(what))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a list, a place and a name, and the name's key."""
    return rows.withColumn("key", text.norm(F.col(name))).filter("session is not null and ord is not null and key <> ''")


def shortcuts(queries: DataFrame, tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """(session, artist, via, ord) of queries (session, query), tracks (session, ord, artist, own, inferred) and albums (session, ord, artist).

    ``exact``: the query is the name of an artist of an own row, and asks for no album.  ``dominant``: the most frequent
    artist of the own rows, with two rows at least; a query that says something must name them and nobody else.
    ``album``: the only artist of the albums, if the query asks for an album or for that artist.  A track is seeded by its
    first row whose artist was not inferred; without one it is not chosen.
    """
    asked = _requests(queries, "query").withColumn("whole", text.norm(F.col("query"))).withColumn("intent", album_intent(F.col("query")))
    explicit = F.when(~_true(F.col("inferred")), F.col("ord"))
    names = _placed(tracks.filter(_true(F.col("own"))), "artist").groupBy("session", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.min(explicit).alias("seed"),
        F.min_by("artist", F.struct("ord", "artist")).alias("shown"), F.min_by("artist", F.when(explicit.isNotNull(), F.struct("ord", "artist"))).alias("named"),
    )
    met = asked.join(names, "session").withColumn("fits", (F.col("whole") != "") & asks_for(F.col("query"), F.col("shown")))
    lists = met.groupBy("session").agg(
        F.max(F.when(~F.col("intent") & (F.col("key") == F.col("whole")) & F.col("seed").isNotNull(), F.struct("named", "seed"))).alias("exact"),
        F.max_by(F.struct("shown", "seed", "n", "fits"), F.struct("n", -F.col("first"), "key")).alias("top"),
        F.count_if(F.col("fits") & F.col("seed").isNotNull()).alias("fitting"),
    )
    covers = _placed(albums, "artist").groupBy("session").agg(
        (F.min("key") == F.max("key")).alias("single"), F.min_by(F.struct("artist", "ord"), F.struct("ord", "artist")).alias("cover")
    )
    told = (F.col("whole") == "") | ((F.col("fitting") == 1) & F.col("top.fits"))
    dominant = _true((F.col("top.n") >= SUPPORT) & F.col("top.seed").isNotNull() & told)
    album = _true(F.col("single") & (F.col("intent") | asks_for(F.col("query"), F.col("cover.artist"))))
    pick = lambda artist, via, at: F.struct(F.col(artist).alias("artist"), F.lit(via).alias("via"), F.col(at).alias("ord"))
    choice = (
        F.when(F.col("exact").isNotNull(), pick("exact.named", "exact", "exact.seed"))
        .when(dominant, pick("top.shown", "dominant", "top.seed"))
        .when(album, pick("cover.artist", "album", "cover.ord"))
    )
    return asked.join(lists, "session", "left").join(covers, "session", "left").select("session", choice.alias("c")).select("session", "c.artist", "c.via", "c.ord")


def pickers(requests: DataFrame, items: DataFrame) -> DataFrame:
    """(session, name, tier, ord) of requests (session, requested) and items (session, ord, name, generic).

    Tiers: 0 the same name, 1 the same without blanks, 2 one name within the other, both of two words at least and
    nobody else asked for, 3 an item that leads to the artist whoever that is (``generic``), 4 the only item, if nobody was
    asked for.  A request of several artists is never answered by one of them.
    """
    asked = _requests(requests, "requested").withColumn("whole", text.norm(F.col("requested"))).withColumn("parts", text.credit_parts(F.col("requested")))
    item = _placed(items, "name").groupBy("session", "key", _true(F.col("generic")).alias("generic")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "name")).alias("at")
    )
    key, whole, part = F.col("key"), F.col("whole"), F.coalesce(F.get("parts", F.lit(0)), F.lit(""))
    several = lambda c: F.size(_words(c)) > 1
    within = (F.size("parts") == 1) & ((part == key) | (several(part) & several(key) & (F.contains(part, key) | F.contains(key, part))))
    tier = F.when(F.col("generic"), 3).when(key == whole, 0).when(text.compact(key) == text.compact(whole), 1).when(within, 2).when(whole == "", 4)
    met = asked.join(item, "session").withColumn("tier", tier)
    best = met.groupBy("session").agg(
        F.min(F.when(F.col("tier").isNotNull(), F.struct("tier", "at.ord", "at.name"))).alias("b"), F.sum(F.when(~F.col("generic"), F.col("n"))).alias("n")
    )
    sure = best.filter((F.col("b.tier") < 4) | (F.col("n") == 1))
    return asked.select("session").join(sure, "session", "left").select("session", "b.name", "b.tier", "b.ord")


def refinement_score(button: Column, query: Column) -> Column:
    """How well a button narrows a query down; null for navigation, tracks, albums, and buttons that share no word with it.

    A button that leads to an artist must be named in full.
    """
    raw = text.clean(button)
    to_artist = raw.rlike(f"^[{SPEAKERS}]")
    shown, target = text.norm(F.when(to_artist, F.regexp_replace(raw, rf"^[{SPEAKERS}]+\s*", "")).otherwise(raw)), text.norm(query)
    have, wanted = _words(shown), _words(target)
    shared = F.size(F.filter(wanted, lambda x: F.array_contains(have, x)))
    likeness = F.when(shown == target, SAME).when(F.contains(shown, target) | F.contains(target, shown), WITHIN).otherwise(0)
    score = shared * SHARED + likeness + F.when(to_artist, 0).otherwise(SONG) - F.greatest(F.size(have) - F.size(wanted), F.lit(0))
    other = parsers.is_control(raw) | parsers.album_row(raw, F.lit(False)).isNotNull() | parsers.track_row(raw).isNotNull()
    return F.when(~other & (shared > 0) & ~(to_artist & (shared < F.size(have))) & (score >= 0), score)


def refinements(requests: DataFrame, buttons: DataFrame) -> DataFrame:
    """(session, button, score, ord) of requests (session, query) and buttons (session, ord, button): the best score, then the first."""
    asked = _requests(requests, "query")
    shown = _placed(buttons, "button").groupBy("session", "button").agg(F.min("ord").alias("ord"))
    met = asked.join(shown, "session").withColumn("score", refinement_score(F.col("button"), F.col("query")))
    best = met.filter("score is not null").groupBy("session").agg(F.max_by(F.struct("button", "score", "ord"), F.struct("score", -F.col("ord"), "button")).alias("b"))
    return asked.select("session").join(best, "session", "left").select("session", "b.button", "b.score", "b.ord")
