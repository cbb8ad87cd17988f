"""Albums, exact tracks, lyrics, spellings and lenient identity over parts, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.functions import wording as w
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query

_ASKED = "CASE p_size % 5 WHEN 0 THEN 'album ' || p_brand WHEN 1 THEN p_brand || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN 'Albums ' || p_name WHEN 3 THEN p_brand ELSE 'other ' || p_name END"


@query(f"""WITH q AS (SELECT p_partkey, p_size % 5 AS k, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part)
SELECT p_partkey, k IN (0, 2) AS asks, array_to_string(CASE k WHEN 1 THEN [x] WHEN 2 THEN [x, y] WHEN 4 THEN ['other', x, y] ELSE [] END, ' ') AS words, k IN (0, 1, 2) AS answers, k IN (1, 2, 4) AS named FROM q""")
def album_wording(t):
    """Whether a query asks for an album, for which, and whether the part's own answers it (R-20, F-18)."""
    asked = t("part").select("p_partkey", "p_brand", "p_name", F.expr(_ASKED).alias("q"))
    said = (F.col("q"), F.col("p_brand"))
    return asked.select(
        "p_partkey", w.asks_for_album(F.col("q")).alias("asks"), F.array_join(w.album_title_words(*said), " ").alias("words"), w.album_answers(*said, F.col("p_name")).alias("answers"),
        w.names_album(*said, F.array("p_name")).alias("named"),
    )


@query("""WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
q AS (SELECT p_partkey AS session, CASE p_partkey % 300 WHEN 0 THEN a WHEN 100 THEN b ELSE a || ' more' END AS said FROM k WHERE p_partkey % 100 = 0)
SELECT session, min(k.p_partkey) AS first, count(k.p_partkey) AS n FROM q LEFT JOIN k ON said IN (a, b) GROUP BY session""")
def exact_tracks(t):
    """Tracks that a query names in full, in either order, by a join of names (R-21)."""
    p, k = t("part"), F.col("p_partkey") % 300
    said = F.when(k == 0, F.concat_ws(" - ", "p_brand", "p_name")).when(k == 100, F.upper(F.concat_ws(" ", "p_name", "p_brand"))).otherwise(F.concat_ws(" ", "p_brand", "p_name", F.lit("more")))
    asked = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("session"), text.norm(said).alias("name"))
    names = p.select("p_partkey", F.explode(w.track_names(F.col("p_brand"), F.col("p_name"))).alias("name"))
    return asked.join(names, "name", "left").groupBy("session").agg(F.min("p_partkey").alias("first"), F.count("p_partkey").alias("n"))


@query("""WITH c AS (SELECT c_custkey, string_agg(CASE WHEN o_orderkey % 5 = 0 THEN '#' || o_orderkey WHEN o_orderkey % 5 = 1 THEN c_name WHEN o_orderkey % 7 = 2 THEN 'via @Store now' ELSE 'line ' || o_orderkey END, chr(10) ORDER BY o_orderkey)
  FILTER (WHERE o_orderkey % 5 > 1 AND o_orderkey % 7 <> 2) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT c_custkey, coalesce(t, '') AS lyrics FROM c""")
def lyrics_lines(t):
    """Texts without brand lines, tags and the bare name (F-24)."""
    key = F.col("o_orderkey")
    line = F.when(key % 5 == 0, F.concat(F.lit("#"), key)).when(key % 5 == 1, F.concat(F.lit("  "), F.upper("c_name"))).when(key % 7 == 2, "via @Store now").otherwise(F.concat(F.lit(" line "), key))
    texts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))).alias("l"))
    return texts.select("c_custkey", w.lyrics(F.array_join(F.col("l.line"), "\n"), F.col("c_name"), F.lit(None).cast("string"), "store").alias("lyrics"))


@query("""WITH p AS (SELECT p_partkey, p_size % 3 = 0 AS guest, p_size % 4 = 0 AS vs, p_name AS n, p_name || CASE WHEN p_size % 3 = 0 THEN ' (feat. ' || p_type || ')' ELSE '' END AS t,
  p_brand || CASE WHEN p_size % 4 = 0 THEN ' Vs. ' || p_type ELSE '' END AS a, p_brand || ' vs ' || p_type AS v FROM part)
SELECT p_partkey, array_to_string(list_filter(['find ' || n, t || ' ' || a, CASE WHEN guest THEN a || ' ' || n END, CASE WHEN guest THEN n || ' ' || a END, CASE WHEN guest THEN n END, CASE WHEN vs THEN v || ' ' || n END, t], lambda x: x IS NOT NULL), '|') AS tries FROM p""")
def query_spellings(t):
    """Queries to try for a track, in order (F-28)."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" (feat. "), "p_type", F.lit(")"))).otherwise(""))
    artist = F.concat("p_brand", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" Vs. "), "p_type")).otherwise(""))
    return t("part").select("p_partkey", F.array_join(w.spellings(F.concat(F.lit(" find  "), "p_name"), artist, title), "|").alias("tries"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p.p_brand AS a, p.p_name AS n, p.p_type AS g, l_linenumber % 4 AS k, f.p_brand AS b, f.p_name AS o, l_suppkey % 2 = 0 AS inferred FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part f ON f.p_partkey = l_partkey - l_partkey % 3)
SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE n = o AND (k = 3 OR contains(a, b) OR contains(b, a))) AS same, count(*) FILTER (WHERE k <> 3 AND (contains(a, b) OR contains(b, a))) AS same_artist,
 min(CASE WHEN k = 3 THEN a ELSE upper(b) END || '/' || CASE WHEN k = 3 OR inferred THEN n ELSE upper(o) END) AS first FROM m GROUP BY l_orderkey, l_linenumber""")
def lenient_identity(t):
    """Lines against files that credit more names, and rows repaired by their files (R-25, R-28)."""
    p = t("part").select("p_partkey", "p_brand", "p_name")
    other = t("part").select(F.col("p_partkey").alias("k"), F.upper("p_brand").alias("b"), F.upper("p_name").alias("o"), "p_type")
    m = t("lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).join(other, F.col("k") == F.col("l_partkey") - F.col("l_partkey") % 3)
    silent = F.col("l_linenumber") % 4 == 3
    credit = F.when(silent, "").when(F.col("l_linenumber") % 4 == 1, F.concat_ws(" & ", "p_type", "b")).otherwise(F.col("b"))
    track = (F.col("p_brand"), F.col("p_name"))
    m = m.withColumn("credit", credit).withColumn("r", w.repaired(*track, F.col("l_suppkey") % 2 == 0, F.when(~silent, F.col("b")), F.col("o")))
    return m.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w.leniently_same_track(*track, F.col("credit"), F.col("o"))).alias("same"), F.count_if(w.leniently_same_artist(F.col("p_brand"), F.col("credit"))).alias("same_artist"),
        F.min(F.concat_ws("/", "r.artist", "r.title")).alias("first"),
    )
