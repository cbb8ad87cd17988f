"""Choices over parts: the artist of a list, an entry of a picker, a narrower search."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import choosing
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

#: What a list is asked for: the brand of its first part, a word of it, an album of it, nothing, or somebody else.
_ASKED = """CASE p_size % 6 WHEN 0 THEN b WHEN 1 THEN 'brand' WHEN 2 THEN 'album ' || b WHEN 3 THEN NULL WHEN 4 THEN 'Nobody Else' ELSE b || ' ' || b END"""


def _first(t):
    return t("part").groupBy("p_size").agg(F.min_by(F.struct("p_brand", "p_name"), "p_partkey").alias("f"))


@query(f"""WITH q AS (SELECT p_size AS session, coalesce({_ASKED}, '') AS query FROM (SELECT p_size, arg_min(p_brand, p_partkey) AS b FROM part GROUP BY p_size)),
w AS (SELECT session, query, {_NORM.format('query')} AS whole, starts_with(query, 'album ') AS intent, list_filter(string_split({_NORM.format('query')}, ' '), lambda x: len(x) > 1 AND x <> 'album') AS words FROM q),
n AS (SELECT p_size AS session, {_NORM.format('p_brand')} AS key, p_brand, count(*) AS n, min(p_partkey) AS first, min(p_partkey) FILTER (WHERE p_partkey % 3 > 0) AS seed FROM part WHERE p_partkey % 4 > 0 GROUP BY p_size, p_brand),
m AS (SELECT w.*, n.* EXCLUDE (session), whole <> '' AND len(words) > 0 AND list_has_all(string_split(key, ' '), words) AS fits FROM w JOIN n USING (session)),
l AS (SELECT session, arg_max(struct_pack(a := p_brand, s := seed, n := n, f := fits), (n, -first)) AS top, count(*) FILTER (WHERE fits AND seed IS NOT NULL) AS fitting, min(CASE WHEN key = whole AND NOT intent THEN seed END) AS exact FROM m GROUP BY session),
a AS (SELECT p_size AS session, count(DISTINCT p_brand) = 1 AS single, arg_min(p_brand, p_partkey) AS artist, min(p_partkey) AS ord FROM part WHERE p_partkey % 4 = 0 AND p_type = 'PROMO' GROUP BY p_size),
r AS (SELECT session, p_brand, top, a.artist, a.ord, exact, coalesce(top.n >= 2 AND top.s IS NOT NULL AND (whole = '' OR fitting = 1 AND top.f), false) AS dominant,
  coalesce(single AND (intent OR query = '' OR len(words) > 0 AND list_has_all(string_split({_NORM.format('artist')}, ' '), words)), false) AS album FROM w LEFT JOIN l USING (session) LEFT JOIN a USING (session) LEFT JOIN part ON p_partkey = exact)
SELECT session, CASE WHEN exact IS NOT NULL THEN p_brand WHEN dominant THEN top.a WHEN album THEN artist END AS artist,
 CASE WHEN exact IS NOT NULL THEN 'exact' WHEN dominant THEN 'dominant' WHEN album THEN 'album' END AS via, CASE WHEN exact IS NOT NULL THEN exact WHEN dominant THEN top.s WHEN album THEN ord END AS ord FROM r""")
def artist_shortcut(t):
    """The artist of a list of results: named by the query, frequent in it, or alone on its albums (R-23)."""
    asked = _first(t).select(F.col("p_size").alias("session"), F.expr(_ASKED.replace(" b", " f.p_brand")).alias("query"))
    part, key = t("part"), F.col("p_partkey")
    rows = part.select(F.col("p_size").alias("session"), key.alias("ord"), F.col("p_brand").alias("artist"), (key % 4 > 0).alias("own"), (key % 3 == 0).alias("inferred"))
    albums = part.filter((key % 4 == 0) & (F.col("p_type") == "PROMO")).select(F.col("p_size").alias("session"), key.alias("ord"), F.col("p_brand").alias("artist"))
    return choosing.shortcuts(asked, rows, albums)


@query(f"""WITH q AS (SELECT p_size AS session, k, coalesce(CASE k WHEN 0 THEN n WHEN 1 THEN replace(n, ' ', '') WHEN 2 THEN 'The ' || n WHEN 3 THEN n || ' & Nobody' END, '') AS requested
  FROM (SELECT p_size, p_size % 5 AS k, arg_min(p_name, p_partkey) AS n FROM part GROUP BY p_size)),
i AS (SELECT p_size AS session, p_partkey AS ord, p_name AS name, p_partkey % 16 = 9 AS generic FROM part WHERE p_type <> 'ECONOMY' OR p_partkey % 16 = 9),
m AS (SELECT session, name, ord, generic, CASE WHEN generic THEN 3 WHEN lower(name) = lower(requested) THEN 0 WHEN replace(lower(name), ' ', '') = replace(lower(requested), ' ', '') THEN 1
  WHEN k < 3 AND contains(lower(requested), lower(name)) THEN 2 WHEN requested = '' THEN 4 END AS tier FROM q JOIN i USING (session)),
b AS (SELECT session, min((tier, ord)) FILTER (WHERE tier IS NOT NULL) AS best, count(*) FILTER (WHERE NOT generic) AS n FROM m GROUP BY session),
s AS (SELECT session, best[1] AS tier, best[2] AS ord FROM b WHERE best[1] < 4 OR n = 1)
SELECT q.session, p_name AS name, tier, ord FROM q LEFT JOIN s USING (session) LEFT JOIN part ON p_partkey = ord""")
def artist_picker(t):
    """The entry of a choice that names the asked artist; several artists are never answered by one (R-24)."""
    n, k, key = F.col("f.p_name"), F.col("p_size") % 5, F.col("p_partkey")
    said = F.when(k == 0, n).when(k == 1, F.replace(n, F.lit(" "), F.lit(""))).when(k == 2, F.concat(F.lit("The "), n)).when(k == 3, F.concat(n, F.lit(" & Nobody")))
    items = t("part").filter((F.col("p_type") != "ECONOMY") | (key % 16 == 9)).select(F.col("p_size").alias("session"), key.alias("ord"), F.col("p_name").alias("name"), (key % 16 == 9).alias("generic"))
    return choosing.pickers(_first(t).select(F.col("p_size").alias("session"), said.alias("requested")), items)


_BUTTON = "CASE p_partkey % 5 WHEN 0 THEN '🎤 ' || p_name WHEN 1 THEN '💿 ' || p_name WHEN 2 THEN p_brand || ', ' || p_name WHEN 3 THEN p_name || ' live' ELSE p_name END"


@query(f"""WITH q AS (SELECT p_size AS session, CASE p_size % 3 WHEN 0 THEN n WHEN 1 THEN split_part(n, ' ', 2) ELSE n || ' live show' END AS query FROM (SELECT p_size, arg_min(p_name, p_partkey) AS n FROM part GROUP BY p_size)),
x AS (SELECT session, p_partkey AS ord, {_BUTTON} AS button, p_partkey % 5 AS k, string_split(query, ' ') AS w, query, p_name || CASE WHEN p_partkey % 5 = 3 THEN ' live' ELSE '' END AS shown FROM part JOIN q ON session = p_size WHERE p_partkey % 5 NOT IN (1, 2)),
y AS (SELECT *, string_split(shown, ' ') AS h, len(list_filter(w, lambda v: list_contains(string_split(shown, ' '), v))) AS shared FROM x),
z AS (SELECT session, ord, button, CAST(shared * 20 + CASE WHEN shown = query THEN 80 WHEN contains(shown, query) OR contains(query, shown) THEN 35 ELSE 0 END + CASE WHEN k = 0 THEN 0 ELSE 8 END - greatest(len(h) - len(w), 0) AS INT) AS score FROM y WHERE shared > 0 AND (k <> 0 OR shared >= len(h))),
b AS (SELECT session, arg_max(struct_pack(b := button, s := score, o := ord), (score, -ord)) AS best FROM z GROUP BY session)
SELECT session, best.b AS button, best.s AS score, best.o AS ord FROM q LEFT JOIN b USING (session)""")
def search_refinement(t):
    """The button that narrows a search down best (R-22)."""
    n, k = F.col("f.p_name"), F.col("p_size") % 3
    said = F.when(k == 0, n).when(k == 1, F.split_part(n, F.lit(" "), F.lit(2))).otherwise(F.concat(n, F.lit(" live show")))
    buttons = t("part").select(F.col("p_size").alias("session"), F.col("p_partkey").alias("ord"), F.expr(_BUTTON).alias("button"))
    return choosing.refinements(_first(t).select(F.col("p_size").alias("session"), said.alias("query")), buttons)
