"""Aliases over parts: chains, cycles and conflicts, and what files teach."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import aliases, matching
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS alias, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey - 1 ELSE p_partkey + p_size END AS target, 1 AS tm FROM part WHERE p_partkey % 50 <> 0 OR p_size % 2 = 0
  UNION ALL SELECT p_partkey, p_partkey // 50 * 50, CASE WHEN p_size = 7 THEN 1 ELSE 0 END FROM part WHERE p_size IN (7, 8)),
n AS (SELECT alias, min(target) AS target, min(target) = max(target) AS sure FROM a WHERE alias <> target AND tm = (SELECT max(tm) FROM a b WHERE b.alias = a.alias AND b.alias <> b.target) GROUP BY alias),
w AS (SELECT alias, target AS cur, [alias] AS way FROM n WHERE sure
  UNION ALL SELECT w.alias, n.target, list_append(way, cur) FROM w JOIN n ON n.alias = w.cur AND n.sure WHERE NOT list_contains(way, cur)),
l AS (SELECT alias, arg_max(cur, len(way)) AS cur, arg_max(way, len(way)) AS way FROM w GROUP BY alias)
SELECT alias, CASE WHEN list_contains(way, cur) THEN alias ELSE cur END AS canonical, CASE WHEN list_contains(way, cur) THEN 'cycle' ELSE 'resolved' END AS state FROM l
UNION ALL SELECT alias, alias, 'conflict' FROM n WHERE NOT sure""")
def alias_chains(t):
    """Chains of up to fifty aliases, some of which bite their tail and some with two newest targets (R-12, X-04)."""
    p, key = t("part"), F.col("p_partkey")
    chain = p.filter("p_partkey % 50 <> 0 or p_size % 2 = 0").select(key.alias("alias"), F.when(key % 50 != 0, key - 1).otherwise(key + F.col("p_size")).alias("target"), F.lit(1).alias("at"))
    more = p.filter("p_size in (7, 8)").select(key.alias("alias"), (key - key % 50).alias("target"), F.when(F.col("p_size") == 7, 1).otherwise(0).alias("at"))
    return aliases.resolve(aliases.links(chain.unionByName(more)))


@query("""WITH b AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS a, lower(p_name) AS t, p_size FROM part),
c AS (SELECT a || '|' || t AS alias, replace(a, ' ', '') AS performer, CASE WHEN p_size % 3 = 0 THEN t || ' remix' ELSE t END AS title, row_number() OVER (PARTITION BY a, t ORDER BY p_size DESC, lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS place FROM b)
SELECT alias, arg_min(performer || '|' || title, place) AS target FROM c WHERE place <= 3 AND title NOT LIKE '% remix' GROUP BY alias""")
def alias_learning(t):
    """Names of files that are another spelling of the track they were cached for (R-12)."""
    p = t("part")
    number = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    key = F.concat_ws("|", F.trim(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", " ")), F.lower("p_name"), number)
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " Remix").otherwise(""))
    cached = p.select(key.alias("track_key"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("performer"), title.alias("title"), F.col("p_size").alias("at"))
    return aliases.learn(p.select(F.col("p_brand").alias("artist"), F.col("p_name").alias("title")), cached)


def _levels_sql(levels: list[tuple[int, str, str]]) -> str:
    """Level after level: rows that no level before has paired, by the places of their keys."""
    parts, taken = [], ""
    for k, (score, left, right) in enumerate(levels):
        side = lambda table, key, o: f"SELECT g, ord AS {o}, {key} AS k, row_number() OVER (PARTITION BY g, {key} ORDER BY ord) AS n FROM {table} x WHERE {key} IS NOT NULL" + (f" AND (g, ord) NOT IN (SELECT g, {o} FROM ({taken}))" if taken else "")
        parts.append(f"m{k} AS MATERIALIZED (SELECT g, l_ord, r_ord, {score} AS score FROM ({side('l', left, 'l_ord')}) JOIN ({side('r', right, 'r_ord')}) USING (g, k, n))")
        taken += f"{' UNION ALL ' if taken else ''}SELECT g, l_ord, r_ord, score FROM m{k}"
    return ", ".join(parts) + " " + taken


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_partkey, l_suppkey, l_extendedprice)) AS k FROM lineitem GROUP BY 1, 2),
j AS (SELECT l_orderkey, l_linenumber AS ord, p_name AS t, lower(p_brand) AS a, p_size FROM i JOIN part ON p_partkey = k),
l AS MATERIALIZED (SELECT l_orderkey AS g, ord, t, CASE WHEN p_size % 4 > 0 THEN a END AS a FROM j), r AS MATERIALIZED (SELECT l_orderkey - 1 AS g, ord, t, CASE WHEN p_size % 3 > 0 THEN a END AS a FROM j), """
       + _levels_sql([(12, "t || a", "t || a"), (8, "CASE WHEN a IS NULL THEN t END", "t"), (8, "t", "CASE WHEN a IS NULL THEN t END")]))
def match_by_score(t):
    """Lines of an order against those of the next: by name and brand, then by name where one side has no brand (J-15)."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p_partkey"))
    ours = t("part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("artist"), F.col("p_name").alias("title"))
    theirs = t("part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.upper("p_brand")).alias("artist"), F.upper("p_name").alias("title"))
    spellings = matching.track_spellings(ours.unionByName(theirs))
    ours, theirs = (matching.spelled(x, spellings) for x in (ours, theirs))
    blocks = [x.select("p_partkey", F.lit(side).alias("side"), F.explode("_blocks").alias("block")) for side, x in enumerate((ours, theirs))]
    rows = lines.join(blocks[0].unionByName(blocks[1]), "p_partkey").withColumn("g", F.col("g") - F.col("side"))
    left, right = matching.with_partners(rows, "g", "p_partkey")
    return matching.match_by_score(left.join(ours, "p_partkey"), right.join(theirs, "p_partkey"), "g", matching.track_levels())
