"""Free-text queries: every part whose key is divisible by 100 asks, by brand and name, for all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import decisions as d
from skeinwork.operators import search
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_WORDS = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

#: Every pair of a query and a track, with its score by the definition (the names hold no versions and one script).
_PAIRS = f"""p AS (SELECT p_partkey AS k, {_WORDS.format('p_brand')} AS a, {_WORDS.format('p_name')} AS b, {_WORDS.format("p_brand || ' ' || p_name")} AS s FROM part),
q AS (SELECT k, s, list_filter(string_split(s, ' '), lambda x: length(x) >= 2) AS w FROM p WHERE k % 100 = 0),
c AS (SELECT q.k AS query_id, p.k AS track_id, len(w) AS total, len(list_filter(w, lambda x: list_contains(string_split(p.a || ' ' || p.b, ' '), x))) AS coverage,
  CASE WHEN contains(q.s, p.b) THEN 8 ELSE 0 END + CASE WHEN contains(q.s, p.a) THEN 6 ELSE 0 END AS bonus, contains(' ' || q.s || ' ', ' ' || p.a || ' ') AS whole_artist FROM q, p),
r AS (SELECT *, 10 * coverage + bonus AS score FROM c WHERE coverage >= 1)"""


def _asked(t):
    p = t("part")
    tracks = p.select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ordinal"))
    return p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_brand", "p_name").alias("query")), tracks


@query(f"""WITH {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coverage DESC, track_id) AS place FROM r)
SELECT query_id, track_id, CAST(score AS INT) AS score, CAST(coverage AS INT) AS coverage, CAST(place AS INT) AS place FROM o WHERE place <= 10""")
def query_score_rank(t):
    """The ten best tracks of each query (R-13 to R-15, R-17)."""
    return search.top(*_asked(t), 10).select("query_id", "track_id", "score", "coverage", "place")


@query(f"""WITH {_PAIRS}, o AS (SELECT *, bool_or(whole_artist) OVER (PARTITION BY query_id) AS any_artist FROM r WHERE coverage = total AND total > 1)
SELECT query_id, track_id, CAST(score AS INT) AS score FROM o WHERE whole_artist OR NOT any_artist""")
def full_coverage_filter(t):
    """The tracks worth showing for each query (R-16)."""
    return search.keep_full(*_asked(t))


@query(f"""WITH g AS (SELECT p_partkey AS k, p_brand || ' ' || p_name AS base, CASE WHEN p_size > 25 THEN p_type ELSE c_mktsegment END AS guest FROM part JOIN customer ON c_custkey = p_partkey WHERE p_partkey % 100 = 0),
q AS (SELECT k, base, base || ' feat. ' || guest AS s, list_filter(string_split({_WORDS.format("base || ' ' || guest")}, ' '), lambda x: length(x) >= 2) AS w FROM g),
p AS (SELECT DISTINCT string_split({_WORDS.format("p_brand || ' ' || p_name || ' ' || p_type")}, ' ') AS h FROM part),
c AS (SELECT k, base || '|' || s AS plan, len(w) AS n, max(len(list_filter(w, lambda x: list_contains(h, x)))) AS best FROM q, p GROUP BY ALL)
SELECT k AS query_id, plan, CAST(best AS INT) AS best, best >= n AS accepted, best < n AS fallback FROM c""")
def search_decisions(t):
    """Queries with a guest: what is sent, what covers them best, and whether that will do (A-19, F-19, R-18, R-19)."""
    guest = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("c_mktsegment"))
    said = F.concat_ws(" ", "p_brand", "p_name", F.lit("feat."), guest)
    asked = t("part").filter("p_partkey % 100 = 0").join(t("customer"), F.col("c_custkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("query_id"), said.alias("query"))
    tracks = t("part").select(F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_partkey").alias("ordinal"))
    best = search.best_coverage(asked, tracks)
    plan, n, never = search.plan(F.col("query")), F.size(search.meaningful(F.col("query"))), F.lit(False)
    told = asked.join(best, "query_id").withColumn("n", n)
    unasked = F.coalesce(F.col("unasked"), F.lit(0))
    return told.select("query_id", F.array_join(plan, "|").alias("plan"), "best", d.accepts_shortened(never, F.col("n"), F.col("best")).alias("accepted"), d.needs_fallback(F.col("n"), F.col("best"), F.col("consensus"), unasked).alias("fallback"))
