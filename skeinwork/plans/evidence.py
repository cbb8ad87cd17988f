"""Evidence over parts and orders: tags of files, candidates of providers, fresh answers, retries, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.functions import evidence as e
from skeinwork.operators import matching
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query

#: Tags that a file of a part has: those of the first of its four, a version, or nothing.
_TITLE = "CASE WHEN p.p_size % 7 = 0 THEN ' ' WHEN p.p_size % 5 = 0 THEN f.p_name || ' Remix' WHEN p.p_size % 5 = 1 THEN f.p_brand || ' - ' || f.p_name ELSE upper(f.p_name) END"
_PERFORMER = "CASE WHEN p.p_size % 3 = 0 THEN NULL WHEN p.p_size % 4 = 1 THEN f.p_brand || ' & ' || f.p_type ELSE replace(f.p_brand, '#', '') END"
_SECONDS = "CAST(CASE WHEN p.p_size % 11 = 0 THEN 0 ELSE f.p_size * 4 END AS BIGINT)"


@query(f"""WITH m AS (SELECT p.p_partkey, p.p_size, p.p_partkey % 6 = 0 AS inferred, p.p_brand = f.p_brand AS b, p.p_name = f.p_name AS n, p.p_type = f.p_type AS ty, trim({_TITLE}) AS title, {_PERFORMER} AS performer, {_SECONDS} AS seconds
  FROM part p JOIN part f ON f.p_partkey = p.p_partkey - p.p_partkey % 4),
c AS (SELECT *, CASE WHEN title <> '' THEN p_size % 5 > 1 AND n END AS t, CASE WHEN performer IS NOT NULL THEN b AND p_size % 4 <> 1 END AS a, CASE WHEN seconds > 0 THEN abs(p_size * 4 - seconds) <= 12 END AS d,
  CASE WHEN title <> '' THEN p_size % 5 > 0 AND n END AS lt, CASE WHEN p_size % 5 = 1 AND title <> '' THEN b WHEN performer IS NOT NULL THEN b AND p_size % 4 = 1 END AS la FROM m)
SELECT p_partkey, NOT (inferred AND performer IS NULL) AND coalesce(t, true) AND coalesce(a, true) AS matches, t AS title, a AS artist, d AS duration,
 array_to_string(list_filter([CASE WHEN NOT t THEN 'title' END, CASE WHEN NOT a THEN 'artist' END, CASE WHEN NOT d THEN 'duration' END], lambda x: x IS NOT NULL), ',') AS against,
 coalesce(t, true) AND coalesce(a, true) AND coalesce(d, true) AND (coalesce(t, false) OR coalesce(a, false)) AS confirmed,
 lt AS loose_title, la AS loose_artist, coalesce(d, true) AND (coalesce(lt, true) OR coalesce(la, true)) AS plausible FROM c""")
def file_evidence(t):
    """Tags of files against tracks: agreeing, contradicting or silent, read strictly and loosely (R-07, R-11)."""
    first = t("part").filter("p_partkey % 4 = 0")
    m = t("part").alias("p").join(first.alias("f"), F.expr("f.p_partkey = p.p_partkey - p.p_partkey % 4"))
    m = m.select("p.*", F.expr(_TITLE).alias("named"), F.expr(_PERFORMER).alias("performer"), F.expr(_SECONDS).alias("got"))
    track = (F.col("p_brand"), F.col("p_name"), (F.col("p_size") * 4).cast("long"))
    tags = (F.col("performer"), F.col("named"), F.col("got"))
    m = m.select("p_partkey", e.file_matches(*track[:2], F.col("p_partkey") % 6 == 0, *tags[:2]).alias("matches"), e.checks(*track, *tags).alias("c"), e.loose_checks(*track, *tags).alias("l"))
    return m.select(
        "p_partkey", "matches", "c.*", F.array_join(e.contradictions(F.col("c")), ",").alias("against"), e.confirmed(F.col("c")).alias("confirmed"),
        F.col("l.title").alias("loose_title"), F.col("l.artist").alias("loose_artist"), e.plausible(F.col("l")).alias("plausible"),
    )


@query("""WITH x AS (SELECT o_orderkey, p_partkey, l_linenumber, w.n, w.b, p_name, p_brand, p_type, CASE WHEN l_linenumber = 2 THEN NULL ELSE abs(o_custkey % 50 + 200.0 - (p_size + 200)) END AS delta, l_linenumber % 3 = 1 AS guests
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT p_partkey AS k, p_name AS n, p_brand AS b FROM part) w ON w.k = o_custkey % 8),
y AS (SELECT *, p_name = n AS t, p_brand = b AS a, coalesce(delta <= 12, true) AS d FROM x),
z AS (SELECT *, CASE WHEN t THEN 100 ELSE 0 END + CASE WHEN a THEN 100 ELSE 0 END + coalesce(greatest(0.0, 30 - 3 * delta), 0) AS score, t AND a AND d AS exact FROM y)
SELECT o_orderkey, arg_max(p_partkey, (score, -l_linenumber, -p_partkey)) AS best, CAST(max(score) AS DOUBLE) AS score, bool_or(exact) AS exact, count(*) FILTER (WHERE t) AS titles, count(*) FILTER (WHERE a) AS artists, count(*) FILTER (WHERE NOT d) AS off FROM z GROUP BY o_orderkey""")
def provider_candidates(t):
    """The best of an order's lines as candidates for the track it asks for, and how they agree (R-10)."""
    asked = t("part").filter("p_partkey < 8").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"))
    rows = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(asked, F.col("k") == F.col("o_custkey") % 8)
    artists = F.when(F.col("l_linenumber") % 3 == 1, F.array("p_type", "p_brand")).otherwise(F.array(F.lower("p_brand"), F.lit(None).cast("string")))
    got = F.when(F.col("l_linenumber") != 2, F.col("p_size") + 200)
    rows = matching.once(rows, ["n", "p_name"], {"title_ok": e.same_title(F.col("n"), F.initcap("p_name"))})
    rows = matching.once(rows.withColumn("artists", artists), ["b", "artists"], {"artist_ok": e.any_artist(F.col("b"), F.col("artists"))})
    made = e.candidate_score(F.col("title_ok"), F.col("artist_ok"), F.col("o_custkey") % 50 + 200, got)
    return rows.select("o_orderkey", "p_partkey", "l_linenumber", made.alias("m")).groupBy("o_orderkey").agg(
        F.max_by("p_partkey", F.struct("m.score", -F.col("l_linenumber"), -F.col("p_partkey"))).alias("best"), F.max("m.score").alias("score"), F.bool_or("m.exact").alias("exact"),
        F.count_if("m.title_ok").alias("titles"), F.count_if("m.artist_ok").alias("artists"), F.count_if(~F.col("m.duration_ok")).alias("off"),
    )


_HIGH = "CASE WHEN p_size % 4 > 0 THEN 'https://' || lower(p_type) || '.example/mp3-320/' || p_partkey END"
_PLAIN = "CASE WHEN p_size % 3 = 0 THEN 'https://' || lower(p_type) || '.example/mp3-320/' || p_partkey WHEN p_size % 3 = 1 THEN 'http://plain.example/' || p_partkey ELSE 'no address' END"
_LOW = "CASE WHEN p_size % 2 = 0 THEN ' https://Low.example/' || p_partkey END"


@query(f"""WITH r AS (SELECT p_partkey, p_size, p_size % 9 = 8 AS empty, p_partkey % 10 = 3 AS other, p_partkey % 7 <> 2 AS a, p_partkey % 5 <> 4 AS t, {_HIGH} AS h, CASE WHEN p_size % 3 = 0 THEN {_PLAIN} END AS m, trim({_LOW}) AS l FROM part),
c AS (SELECT *, list_filter([CASE WHEN h IS NOT NULL THEN h || ' 320 high' END, CASE WHEN m IS DISTINCT FROM h AND m IS NOT NULL THEN m || ' 320 plain' END, l || ' 128 low'], lambda x: x IS NOT NULL) AS found FROM r),
v AS (SELECT *, CASE WHEN empty AND len(found) = 0 THEN 'empty' WHEN other AND NOT empty THEN 'id ' || (p_partkey + 1) || ' instead of ' || p_partkey WHEN empty OR NOT a AND NOT t THEN 'artist and title differ' WHEN NOT a THEN 'artist differs' WHEN NOT t THEN 'title differs' WHEN len(found) = 0 THEN 'no link' END AS reason FROM c)
SELECT p_partkey, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN reason IS NULL THEN array_to_string(found, '|') END AS candidates FROM v""")
def recovery_evaluation(t):
    """A catalogue's fresh answer for a part: whose it is, and where it can be fetched (R-09)."""
    key, size = F.col("p_partkey"), F.col("p_size")
    answered = lambda x: F.when(size % 9 != 8, x)
    theirs = answered(F.when(key % 10 == 3, key + 1).otherwise(key).cast("string"))
    artist = answered(F.when(key % 7 == 2, F.lit("Somebody")).otherwise(F.upper("p_brand")))
    title = answered(F.when(key % 5 == 4, F.concat("p_name", F.lit(" (Live)"))).otherwise(F.initcap("p_name")))
    found = e.links((F.expr(_HIGH), 256, "high"), (F.expr(_PLAIN), None, "plain"), (F.expr(_LOW), 128, "low"))
    made = e.recovered(key.cast("string"), theirs, F.col("artist_ok"), F.col("title_ok"), F.col("nothing"), F.lit(None).cast("int"), F.col("found"))
    row = lambda x: F.concat_ws(" ", x["url"], x["quality"].cast("string"), x["source"])
    read = t("part").withColumn("found", found).withColumns({"artist_ok": e.same_artist(F.col("p_brand"), artist), "title_ok": e.same_title(F.col("p_name"), title), "nothing": e.says_nothing(F.col("found"), theirs, artist, title)})
    return read.select("p_partkey", made.alias("m")).select("p_partkey", "m.ok", "m.reason", "m.id", F.when(F.col("m.ok"), F.array_join(F.transform("m.candidates", row), "|")).alias("candidates"))


@query("""WITH a AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT user_id, event_type = 'signup' OR (k % 3 < 2 AND event_type = 'error' AND k % 5 <> 0) AS again FROM a)
SELECT user_id, count(*) AS uploads, count(*) FILTER (WHERE again) AS again FROM r GROUP BY user_id""")
def upload_retries(t):
    """How many uploads of a user may be tried again, by what their last attempt says (P-25)."""
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(k % 5 == 0, "HTTP 404").otherwise(" unexpected  content-type text/plain;x")
    ok = F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "purchase", True)
    attempt = F.when(F.col("event_type") != "signup", F.struct((k % 3).alias("version"), ok.alias("ok"), reason.alias("reason")))
    rows = t("events").select("user_id", e.retryable(attempt).alias("again"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("uploads"), F.count_if("again").alias("again"))


_SAID = """CASE l_partkey % 6 WHEN 0 THEN 'parts:' || l_orderkey || ':320:a.example' WHEN 1 THEN 'other:1:' || l_orderkey || ':128:h' WHEN 2 THEN 'parts:0:' || l_orderkey || ':128:h'
 WHEN 3 THEN ' parts:' || l_linenumber || ':' || l_orderkey || '::b.example ' WHEN 4 THEN 'parts:' || l_linenumber || '::128:h' ELSE NULL END"""


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS k, coalesce({_SAID}, 'parts:' || (l_linenumber + 1) || ':' || l_orderkey || ':' || l_suppkey || ':c.example') AS said, l_suppkey FROM lineitem)
SELECT said, count(*) AS n, CASE WHEN k = 0 THEN 1 WHEN k = 3 THEN l_linenumber WHEN k = 5 THEN l_linenumber + 1 END AS slot, CASE WHEN k IN (0, 3, 5) THEN CAST(l_orderkey AS VARCHAR) END AS id,
 CASE WHEN k = 0 THEN 320 WHEN k = 5 AND l_suppkey > 0 THEN l_suppkey END AS quality, CASE k WHEN 0 THEN 'a.example' WHEN 3 THEN 'b.example' WHEN 5 THEN 'c.example' END AS host FROM c GROUP BY ALL""")
def caption_codec(t):
    """Captions of sent files, written and read, with and without a slot (F-25)."""
    written = e.caption("parts", F.col("l_linenumber") + 1, F.col("l_orderkey"), F.col("l_suppkey"), F.lit("c.example"))
    rows = t("lineitem").groupBy(F.coalesce(F.expr(_SAID), written).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("said", "n", e.read_caption("parts", F.col("said")).alias("c")).select("said", "n", "c.*")
