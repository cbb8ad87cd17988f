"""Ranking tracks for free-text queries, by rare keys.

What a query says and what a track's fields are is worked out once for each distinct text.  Runs of
query words that are a whole field (spelt without blanks, or in the other script with the same
consonants) are found by a join of distinct runs and distinct fields.  A word of a query is then
covered by a track that has the word, or one of whose fields is a run that holds it; these are the
word's keys, and the tracks that have them its cost.

A track that covers all words of a query covers the cheapest one, so only the cheapest word's keys are
looked up; one that covers all but s covers one of the s + 1 cheapest.  ``top`` raises s until the k-th
best score cannot be reached by a track that covers less, so it is exact and frequent words are looked up only
for queries that have nothing better.  Tracks of equal artist and title are one until the end.

Fields in the other script are met by keys that no pair within the allowed edits can miss: letters
left out of the first and last word, and the thirds of the joined consonants by place (two edits
leave one third as it was).

Edge cases: null texts are empty; a query without words finds nothing; fields without letters match
nothing; repeated tracks are returned each; ties go by the source's order, then track_id; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.runtime import materialize

# Words that carry no identity in a query, and points.
NOISE = ("ft", "feat", "featuring", "with", "and", "vs", "the", "a", "an")
COMMANDS = ("download", "آهنگ", "اهنگ", "موزیک", "ترانه", "دانلود")
CONNECTIVES = ("از", "با", "همراه", "همراهی")
COVERED, TITLE, ARTIST, UNASKED, INFERRED = 10, 8, 6, 18, 1

#: The share of a list that one artist in the other script needs to stand for a query of one word.
CONSENSUS = 0.8


def raw_tokens(value: Column) -> Column:
    """Search tokens; two-word variant labels become one."""
    one = F.regexp_replace(F.concat(F.lit(" "), text.search_norm(value), F.lit(" ")), " بی کلام ", " بیکلام ")
    return F.filter(F.split(F.regexp_replace(one, " اجرای زنده ", " لایو "), " "), lambda x: x != "")


def _kinds() -> Column:
    return F.create_map(*(F.lit(x) for pair in text.VARIANT_KINDS.items() for x in pair))


def canonical(tokens: Column) -> Column:
    """Tokens with variant words as their kind."""
    kinds = _kinds()
    return F.transform(tokens, lambda x: F.coalesce(F.concat(F.lit("@variant:"), F.try_element_at(kinds, x)), x))


def meaningful(query: Column) -> Column:
    """Tokens of a query that carry identity: noise goes, commands and connectives where enough is left."""
    base = F.filter(raw_tokens(query), lambda x: (F.char_length(x) >= 2) & ~x.isin(*NOISE, *text.ALBUM_WORDS, *text.ALBUM_SUFFIXES))
    left = F.filter(base, lambda x: ~x.isin(*COMMANDS))
    tokens = F.when(F.size(left) > 0, left).otherwise(base)
    bare = F.filter(tokens, lambda x: ~x.isin(*CONNECTIVES))
    return F.when(F.size(bare) >= 2, bare).otherwise(tokens)


def plan(query: Column) -> Column:
    """The queries to send, in order: without what follows "feat" first, unless a version was asked for."""
    full = text.clean(F.coalesce(query, F.lit("")))
    base = F.trim(F.regexp_replace(full, r"(?iU)\s+(?:feat\.?|ft\.?|featuring)\s+.+$", ""))
    words = "|".join([*text.VARIANT_KINDS, r"اجرای\s*زنده", r"بی(?:\x{200C}|\s|-)*کلام"])
    version = full.rlike(rf"(?iU)(?:^|\s)(?:{words})(?:\s|$)")
    both = F.when(version, F.array(full, base)).otherwise(F.array(base, full))
    return F.array_distinct(F.filter(F.when(base == full, F.array(full)).otherwise(both), lambda x: x != ""))


def _runs(tokens: Column) -> Column:
    """All runs of an array of tokens as (a, b, words)."""
    at = F.sequence(F.lit(1), F.size(tokens))
    runs = F.flatten(F.transform(at, lambda a: F.transform(F.sequence(a, F.size(tokens)), lambda b: F.struct(a.alias("a"), b.alias("b"), F.slice(tokens, a, b - a + 1).alias("words")))))
    return F.when(F.size(tokens) > 0, runs)


def _left_out(word: str) -> set[str]:
    """A word and, if it is long enough to be matched with an edit, what is left without one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) >= 3)}


def _ends(words: list[str]) -> set[str]:
    return {f"1 {len(words)} {a} {b}" for a in _left_out(words[0]) for b in _left_out(words[-1])} if words[0] and words[-1] else set()


def _thirds(n: int) -> list[tuple[int, int]]:
    return [(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]


def field_keys(words: list[str]) -> set[str]:
    """Keys of a field's consonants."""
    s = "".join(words)
    n = len(s)
    if not s:
        return set()
    return {f"= {s}", *_ends(words), *(f"2 {n} {i} {s[a:b]}" for i, (a, b) in enumerate(_thirds(n)) if n >= 5)}


def run_keys(words: list[str]) -> set[str]:
    """Keys of a run's consonants: one at least of any field within the edits that ``text.near_bones`` allows."""
    s = "".join(words)
    n = len(s)
    if not s:
        return set()
    thirds = {f"2 {m} {i} {s[a + d : b + d]}" for m in range(max(5, n - 2), n + 3) for i, (a, b) in enumerate(_thirds(m)) for d in range(-2, 3) if 0 <= a + d and b + d <= n}
    return {f"= {s}", *_ends(words), *thirds}


def _keyed(rows: DataFrame, column: str, of: object) -> DataFrame:
    """(column, key) of rows (column, bones)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(x, k) for x, words in zip(batch[column], batch["bones"]) for k in of([*words])]
            yield pd.DataFrame(made, columns=[column, "key"])

    return rows.select(column, "bones").mapInPandas(run, f"{column} string, key string")


@dataclass
class Index:
    """Distinct queries and tracks, what meets whole fields, and the keys of words by cost."""

    asked: DataFrame  # (query_id, q)
    listed: DataFrame  # (track_id, ordinal, t)
    queries: DataFrame  # (q, query, tokens, raw, words)
    tracks: DataFrame  # (t, artist, title, artist_value, title_value, inferred, have, compacts, title_raw, first, n)
    hits: DataFrame  # (q, stream, a, b, value, crossed): a run that is a whole field
    spots: DataFrame  # (q, key, place): keys of the words, cheapest word first
    keys: DataFrame  # (t, key)


def index(queries: DataFrame, tracks: DataFrame) -> Index:
    """The index of ``queries`` (query_id, query) over ``tracks`` (track_id, artist, title, ordinal, perhaps artist_inferred)."""
    asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    q = asked.groupBy("query").agg(F.min("query_id").alias("q"))
    q = q.withColumn("words", meaningful(F.col("query"))).withColumn("tokens", canonical(F.col("words"))).withColumn("raw", raw_tokens(F.col("query")))
    q = materialize(q, "queries")
    inferred = F.coalesce("artist_inferred", F.lit(False)) if "artist_inferred" in tracks.columns else F.lit(False)
    named = tracks.select("track_id", "ordinal", F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("title", F.lit("")).alias("title"), inferred.alias("inferred"))
    same = ["artist", "title", "inferred"]
    t = named.groupBy(*same).agg(F.min_by("track_id", F.struct("ordinal", "track_id")).alias("t"), F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    tokens = lambda c: canonical(raw_tokens(F.col(c)))
    t = t.withColumn("artist_tokens", tokens("artist")).withColumn("title_raw", raw_tokens(F.col("title"))).withColumn("title_tokens", canonical(F.col("title_raw")))
    t = t.withColumn("have", F.array_union("artist_tokens", "title_tokens")).withColumn("compacts", F.array(F.array_join("artist_tokens", ""), F.array_join("title_tokens", "")))
    t = materialize(t.withColumn("artist_value", text.clean(F.col("artist"))).withColumn("title_value", text.clean(F.col("title"))).drop("artist_tokens", "title_tokens"), "tracks")
    fields = t.select(F.explode(F.array("artist_value", "title_value")).alias("value")).distinct().withColumn("compact", F.array_join(tokens("value"), "")).filter("compact <> ''")
    fields = materialize(fields.withColumn("bones", text.bones(F.col("value"))).withColumn("script", text.script(F.col("value"))), "fields")
    runs = None
    for stream, source in (("words", "words"), ("raw", "raw"), ("whole", None)):
        if source:
            run = q.select("q", F.explode(_runs(F.col(source))).alias("r")).select("q", F.lit(stream).alias("stream"), "r.*").withColumn("tokens", canonical(F.col("words")))
            phrase = F.when(~F.exists("tokens", lambda x: x.startswith("@variant:")), F.array_join("words", " "))
            run = run.select("q", "stream", "a", "b", F.array_join("tokens", "").alias("compact"), phrase.alias("phrase"))
        else:
            run = q.select("q", F.lit(stream).alias("stream"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(None).cast("string").alias("compact"), text.clean(F.col("query")).alias("phrase"))
        runs = run if runs is None else runs.unionByName(run)
    runs = materialize(runs, "runs")
    phrases = runs.select("phrase").filter("phrase <> ''").distinct()
    phrases = materialize(phrases.withColumn("bones", text.bones(F.col("phrase"))).withColumn("script", text.script(F.col("phrase"))).filter("script <> ''"), "phrases")
    met = _keyed(phrases, "phrase", run_keys).join(_keyed(fields.filter("script <> ''"), "value", field_keys), "key").select("phrase", "value").distinct()
    both = met.join(phrases.withColumnsRenamed({"bones": "pb", "script": "ps"}), "phrase").join(fields.select("value", F.col("bones").alias("fb"), F.col("script").alias("fs")), "value").filter("ps <> fs")
    told = both.select("phrase", "value", text.same_bones(F.col("pb"), F.col("fb")).alias("identity"), text.near_bones(F.col("pb"), F.col("fb")).alias("near")).filter("near")
    crossed = runs.join(told, "phrase").filter("stream <> 'whole' or identity").select("q", "stream", "a", "b", "value", F.lit(True).alias("crossed"))
    spelt = runs.filter("compact <> ''").join(fields.select("value", "compact"), "compact").select("q", "stream", "a", "b", "value", F.lit(False).alias("crossed"))
    hits = materialize(crossed.unionByName(spelt).distinct(), "hits")
    of = lambda kind, c: F.concat(F.lit(f"{kind} "), c)
    keys = t.select("t", F.explode(F.array_distinct(F.concat(F.transform("have", lambda x: of("w", x)), F.array(of("f", F.col("artist_value")), of("f", F.col("title_value")))))).alias("key"))
    keys = materialize(keys, "keys")
    spots = q.select("q", F.posexplode("tokens").alias("i", "x")).select("q", (F.col("i") + 1).alias("i"), of("w", F.col("x")).alias("key"))
    spots = spots.unionByName(hits.filter("stream = 'words'").select("q", F.explode(F.sequence("a", "b")).alias("i"), of("f", F.col("value")).alias("key"))).distinct()
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    costs = spots.join(often, "key", "left").groupBy("q", "i").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("cost"))
    costs = costs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("cost", "i")))
    spots = materialize(spots.join(costs, ["q", "i"]).select("q", "key", "place"), "spots")
    members = named.join(t.select(*same, "t"), same).select("track_id", "ordinal", "t")
    return Index(asked.join(q.select("query", "q"), "query").select("query_id", "q"), members, q, t, hits, spots, keys)


def covered(tokens: list[str], have: set[str], compacts: set[str], spans: list[tuple[int, int]]) -> int:
    """How many ``tokens`` a track covers: by a word it has, by a run of words it lacks that is a whole field
    without blanks, or within a span (from 1) that is a field in the other script."""
    seen = [x in have for x in tokens]
    at = 0
    while at < len(tokens):
        stop = at
        if not seen[at]:
            free = at
            while free < len(tokens) and not seen[free]:
                free += 1
            stop = next((b for b in range(at + 1, free + 1) if "".join(tokens[at:b]) in compacts), at)
            seen[at:stop] = [True] * (stop - at)
        at = max(stop, at + 1)
    for a, b in spans:
        seen[a - 1 : b] = [True] * (b - a + 1)
    return sum(seen)


def _covered(*columns: str | Column) -> Column:
    @F.pandas_udf("int")
    def count(tokens: pd.Series, have: pd.Series, compacts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([covered([*a], {*b}, {*c} - {""}, [(x["a"], x["b"]) for x in d]) for a, b, c, d in zip(tokens, have, compacts, spans)])

    return count(*columns)


def _scored(made: Index, pairs: DataFrame) -> DataFrame:
    """Scores of distinct ``pairs`` (q, t)."""
    best = made.hits.filter("stream = 'words' and crossed").groupBy("q", "value").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("span"))
    whole = made.hits.filter("stream <> 'whole'").select("q", "value", F.lit(True).alias("whole")).distinct()
    both = pairs.join(made.queries, "q").join(made.tracks, "t")
    for side in ("artist", "title"):
        both = both.join(best.withColumnsRenamed({"value": f"{side}_value", "span": f"{side}_span"}), ["q", f"{side}_value"], "left")
        both = both.join(whole.withColumnsRenamed({"value": f"{side}_value", "whole": f"whole_{side}"}), ["q", f"{side}_value"], "left")
    kinds = _kinds()
    wanted = F.transform("raw", lambda x: F.try_element_at(kinds, x))
    unasked = F.size(F.filter("title_raw", lambda x: F.try_element_at(kinds, x).isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(wanted), F.try_element_at(kinds, x)), F.lit(False))))
    has = lambda f: (text.search_norm(F.col(f)) != "") & F.contains(text.search_norm(F.col("query")), text.search_norm(F.col(f)))
    told = both.select(
        "q", "t", "first", "n", F.size("tokens").alias("total"), _covered("tokens", "have", "compacts", F.array_compact(F.array("artist_span", "title_span"))).alias("coverage"), unasked.alias("unasked"),
        F.coalesce("whole_artist", F.lit(False)).alias("whole_artist"), F.coalesce("whole_title", F.lit(False)).alias("whole_title"),
        (F.when(has("title"), TITLE).otherwise(0) + F.when(has("artist"), ARTIST).otherwise(0) - F.when(F.col("inferred"), INFERRED).otherwise(0)).alias("bonus"),
    )
    return told.withColumn("score", COVERED * F.col("coverage") + F.col("bonus") - UNASKED * F.col("unasked")).drop("bonus")


def candidates(made: Index, slack: int = 0) -> DataFrame:
    """Scored pairs (q, t) with all those that cover a query's words but ``slack``."""
    pairs = made.spots.filter(F.col("place") <= slack + 1).join(made.keys, "key").select("q", "t").distinct()
    return _scored(made, pairs)


def top(queries: DataFrame, tracks: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, track_id, score, coverage, total, unasked, place): the ``k`` best tracks that cover a word, by score, coverage
    and the source's order."""
    return _top(index(queries, tracks), k)


def _top(made: Index, k: int) -> DataFrame:
    order = (F.desc("score"), F.desc("coverage"), "first", "t")
    found, slack = None, 0
    left = Index(made.asked, made.listed, made.queries.filter(F.size("tokens") > 0), made.tracks, made.hits, made.spots, made.keys)
    most = made.queries.agg(F.max(F.size("tokens"))).first()[0] or 0
    while slack < most:
        sure = candidates(left, slack).filter((F.col("coverage") >= F.greatest(F.col("total") - slack, F.lit(1))))
        # classes in order, with the rows that come before
        placed = sure.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("place") <= k)
        placed = materialize(placed.withColumn("rows", F.sum("n").over(Window.partitionBy("q").orderBy("place"))), f"places-{slack}")
        reach = COVERED * (F.col("total") - slack - 1) + TITLE + ARTIST  # the most that a track covering less can score
        done = placed.filter((F.col("rows") >= k) | (F.col("place") == k)).groupBy("q").agg(F.max("score").alias("last"), F.max("total").alias("total")).filter((F.col("last") >= reach))
        over = made.queries.filter(F.size("tokens") == slack + 1).select("q")
        done = materialize(left.queries.join(done.select("q").unionByName(over).distinct(), "q", "left_semi").select("q"), f"done-{slack}")
        now = placed.join(done, "q", "left_semi")
        found = now if found is None else found.unionByName(now)
        rest = materialize(left.queries.join(done, "q", "left_anti"), f"left-{slack}")
        left = Index(made.asked, made.listed, rest, made.tracks, made.hits, left.spots.join(rest.select("q"), "q", "left_semi"), made.keys)
        slack += 1
        if rest.isEmpty():
            break
    if found is None:
        found = candidates(made).withColumn("place", F.lit(0)).limit(0)
    return _members(made, found, k)


def _members(made: Index, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query out of its best classes; of a class no more than ``k`` can be among them."""
    few = made.listed.withColumn("_k", F.row_number().over(Window.partitionBy("t").orderBy("ordinal", "track_id"))).filter(F.col("_k") <= k)
    rows = found.select("q", "t", "score", "coverage", "total", "unasked").join(few, "t")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("coverage"), "ordinal", "track_id")
    rows = rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return made.asked.join(rows, "q").select("query_id", "track_id", "score", "coverage", "total", "unasked", "place")


def _artists(made: Index) -> DataFrame:
    return made.tracks.select("t", "n", F.col("artist_value").alias("value"), text.norm(F.col("artist")).alias("artist_key"), text.script_family(F.col("artist")).alias("family")).filter("artist_key <> ''")


def _consensus(made: Index, queries: DataFrame) -> DataFrame:
    """(q, artist_key) of those ``queries`` (q, query, total) of one word that are, in the other script, the artist of most tracks."""
    one = queries.filter("total = 1").withColumn("asked", text.script_family(F.col("query"))).filter("asked <> 'mixed'")
    of = made.hits.filter("stream = 'whole'").select("q", "value").join(one, "q").join(_artists(made), "value").filter("family <> 'mixed' and asked <> family")
    enough = made.tracks.agg(F.greatest(F.lit(2), F.ceil(F.sum("n") * CONSENSUS)).alias("enough"))  # one row
    return of.groupBy("q", "artist_key").agg(F.sum("n").alias("n")).join(F.broadcast(enough), F.col("n") >= F.col("enough")).select("q", "artist_key")


def best_coverage(queries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(query_id, best, unasked, consensus): the most words of a query that a track covers, the unasked variants of the best
    track, and whether a query of one word has a consensus."""
    made = index(queries, tracks)
    first = _top(made, 1).select("query_id", "coverage", "unasked")
    agreed = made.asked.join(_consensus(made, made.queries.select("q", "query", F.size("tokens").alias("total"))), "q").select("query_id", F.lit(True).alias("consensus")).distinct()
    told = made.asked.select("query_id").join(first, "query_id", "left").join(agreed, "query_id", "left")
    return told.select("query_id", F.coalesce("coverage", F.lit(0)).alias("best"), "unasked", F.coalesce("consensus", F.lit(False)).alias("consensus"))


def keep_full(queries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(query_id, track_id, score): the tracks worth showing.

    Of several words: fully covered tracks; without unasked variants, and of a whole artist, where there are such; if
    none is covered, those whose artist or title is the whole query in the other script.  Of one word: covered tracks
    of which it is a whole field; if none is covered, all of the one artist in the other script that ``CONSENSUS`` of
    all tracks agree on.
    """
    made = index(queries, tracks)
    full = materialize(candidates(made).filter("coverage = total"), "full")
    every = Window.partitionBy("q")
    several = full.filter("total > 1").withColumn("any_clean", F.max(F.col("unasked") == 0).over(every)).filter("not any_clean or unasked = 0")
    several = several.withColumn("any_artist", F.max("whole_artist").over(every)).filter("not any_artist or whole_artist")
    single = full.filter("total = 1 and (whole_artist or whole_title)")
    none = made.queries.join(full.select("q").distinct(), "q", "left_anti").select("q", "query", F.size("tokens").alias("total"))
    same = made.hits.filter("stream = 'whole'").select("q", "value").join(none, "q")
    exact = same.filter("total > 1").join(made.tracks.select("t", F.explode(F.array("artist_value", "title_value")).alias("value")), "value").select("q", "t")
    meant = _consensus(made, none).join(_artists(made), "artist_key").select("q", "t")
    extra = _scored(made, exact.unionByName(meant).distinct())
    columns = ["q", "t", "score"]
    kept = several.select(*columns).unionByName(single.select(*columns)).unionByName(extra.select(*columns))
    return made.asked.join(kept, "q").join(made.listed, "t").select("query_id", "track_id", "score")
