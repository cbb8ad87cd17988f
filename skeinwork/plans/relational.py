"""Scans, predicates, joins, aggregations, windows, orders and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import policy, text
from skeinwork.operators import matching
from skeinwork.plans.base import AS_OF, Catalogue
from skeinwork.runtime import materialize

catalogue = Catalogue()
query = catalogue.query
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _norm(c: str) -> str:
    return _NORM.format(c)


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(f"""
WITH k AS (SELECT *, {_norm('p_brand')} || '|' || {_norm('p_name')} AS track_key FROM part),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY track_key ORDER BY p_partkey) = 1),
r AS (SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_partkey)
SELECT p_brand, track_key, p_partkey, revenue, rank FROM (
  SELECT p_brand, track_key, p_partkey, revenue,
    row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC NULLS LAST, md5(track_key)) AS rank
  FROM f LEFT JOIN r ON l_partkey = p_partkey) WHERE rank <= 2""")
def identity_topk_per_group(t):
    """Identity keys, first occurrence, revenue and the two best per brand."""
    first = matching.first_of(t("part").withColumn("track_key", text.identity_key(F.col("p_brand"), F.col("p_name"))), ["track_key"], F.col("p_partkey"))
    revenue = t("lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    joined = first.join(revenue, first.p_partkey == revenue.l_partkey, "left")
    return matching.top(joined, ["p_brand"], 2, F.desc_nulls_last("revenue"), F.md5("track_key"), rank="rank").select("p_brand", "track_key", "p_partkey", "revenue", "rank")


@query("SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 30 AND l_quantity < 40 AND l_discount >= 0.05")
def scan_project_filter(t):
    li = t("lineitem").filter("l_quantity > 30 and l_quantity < 40 and l_discount >= 0.05")
    return li.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50)")
def point_lookup_keys(t):
    keys = t("customer").select("c_custkey").orderBy("c_custkey").limit(50)
    o = t("orders")
    return o.join(F.broadcast(keys), o.o_custkey == keys.c_custkey, "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, (SELECT split_part(min(p_name), ' ', 1) FROM part))")
def prefix_family_scan(t):
    p = t("part")
    first = p.agg(F.split_part(F.min("p_name"), F.lit(" "), F.lit(1)).alias("prefix"))
    return p.join(F.broadcast(first), F.startswith("p_name", "prefix"), "left_semi").select("p_partkey", "p_name")


@query("SELECT user_id, event_id, event_type FROM events")
def json_rowset_inline(t):
    """Rows to a JSON array per user and day, and back by a schema."""
    e = t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type"))).alias("j"))
    return e.select("user_id", F.inline(F.from_json("j", "array<struct<event_id:bigint,event_type:string>>")))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def array_zip_rowset(t):
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    a = t("orders").groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("k"), F.col("r.o_totalprice").alias("p"))
    return a.select("o_custkey", F.inline(F.arrays_zip("k", "p"))).toDF("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents")
def qa_row_counts(t):
    out = None
    for name, alias in (("part", "parts"), ("orders", "orders"), ("events", "events"), ("documents", "documents")):
        one = t(name).agg(F.count(F.lit(1)).alias(alias))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


@query("""SELECT p_partkey, url, quality FROM (SELECT p_partkey, unnest([
 {'url': 'https://' || CASE WHEN p_partkey < 725 THEN 'a' ELSE 'b' END || '.example/mp3-320/' || p_partkey, 'quality': 320},
 {'url': 'https://' || CASE WHEN p_partkey < 725 THEN 'b' ELSE 'a' END || '.example/mp3-320/' || p_partkey, 'quality': 320},
 {'url': 'https://' || CASE WHEN p_partkey < 725 THEN 'a' ELSE 'b' END || '.example/mp3-256/' || p_partkey, 'quality': 256},
 {'url': 'https://' || CASE WHEN p_partkey < 725 THEN 'b' ELSE 'a' END || '.example/mp3-256/' || p_partkey, 'quality': 256}], recursive := true) FROM part)""")
def candidate_url_generator(t):
    near, far = F.when(F.col("p_partkey") < 725, "a").otherwise("b"), F.when(F.col("p_partkey") < 725, "b").otherwise("a")
    each = [F.struct(F.concat(F.lit("https://"), h, F.lit(f".example/mp3-{q}/"), F.col("p_partkey")).alias("url"), F.lit(q).alias("quality")) for q in (320, 256) for h in (near, far)]
    return t("part").select("p_partkey", F.inline(F.array(*each)))


@query("SELECT count(*) AS n, count(nullif(trim(coalesce(nullif(l, '.'), '')), '')) AS nonblank FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)")
def nonblank_predicate(t):
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("l"))
    blank = F.trim(F.coalesce(F.nullif("l", F.lit(".")), F.lit("")))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif(blank, F.lit(""))).alias("nonblank"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'ing')")
def token_conjunction_search(t):
    wanted = F.array(*map(F.lit, ("the", "tion", "ing")))
    return t("documents").filter(F.forall(wanted, lambda w: F.contains(F.lower("text"), w))).select("doc_id")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k') AND CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 60")
def json_field_filter(t):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t("events").filter(F.array_contains(F.json_object_keys("props"), "k")).withColumn("k", k).filter(F.col("k").between(10, 60)).select("event_id", "k")


@query(f"SELECT event_type, count(*) AS fresh FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 432000000 MILLISECOND GROUP BY event_type")
def ttl_freshness(t):
    return t("events").filter(F.col("ts") >= _as_of() - F.expr("make_dt_interval(0, 0, 0, 432000.0)")).groupBy("event_type").agg(F.count(F.lit(1)).alias("fresh"))


@query("SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING bool_and(l_quantity >= 10)")
def all_or_nothing_list(t):
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_quantity") >= 10).alias("all"))
    return lists.filter("all").select("o_orderkey")


@query("""SELECT count(*) FILTER (WHERE l_returnflag <> 'R' OR e) AS trusted, count(*) FILTER (WHERE NOT (l_returnflag <> 'R' OR e)) AS quarantined
FROM (SELECT l_returnflag, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AS e FROM lineitem)""")
def trust_exists_filter(t):
    good = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("e")).distinct()
    trusted = (F.col("l_returnflag") != "R") | F.coalesce("e", F.lit(False))
    return t("lineitem").join(good, "l_orderkey", "left").agg(F.count_if(trusted).alias("trusted"), F.count_if(~trusted).alias("quarantined"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey, CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'foreign' WHEN 'machinery' THEN 'iranian' ELSE 'unknown' END AS origin,
 CASE WHEN c_acctbal < 0 THEN 'blocked_copyright' ELSE 'unknown' END AS stated FROM customer),
a AS (SELECT *, CASE WHEN stated <> 'unknown' THEN stated WHEN origin = 'foreign' THEN 'iran_only' WHEN origin = 'iranian' THEN 'global' ELSE 'unknown' END AS policy FROM p)
SELECT c_custkey, policy, CASE WHEN policy = 'blocked_copyright' THEN 'copyright' WHEN policy <> 'iran_only' THEN 'not_region_restricted'
 WHEN c_nationkey = 10 THEN 'iran_verified' ELSE 'iran_only' END AS reason,
 NOT (policy = 'blocked_copyright' OR (policy = 'iran_only' AND c_nationkey <> 10)) AS allowed FROM a""")
def policy_decision(t):
    c = t("customer")
    seg = F.lower(F.trim("c_mktsegment"))
    origin = F.when(seg == "building", "foreign").when(seg == "machinery", "iranian").otherwise("x")
    stated = F.when(F.col("c_acctbal") < 0, "Blocked_Copyright ").otherwise("none")
    made = c.select("c_custkey", "c_nationkey", policy.availability(origin, stated).alias("policy"))
    allowed, reason = policy.delivery(F.col("policy"), F.when(F.col("c_nationkey") == 10, "ir"))
    return made.select("c_custkey", "policy", reason.alias("reason"), allowed.alias("allowed"))


@query("SELECT l_orderkey, l_linenumber, canonical FROM lineitem JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS canonical FROM part) ON p_partkey = l_partkey")
def inner_join_alias(t):
    p = t("part")
    canon = p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("canonical")), "p_name").select("p_partkey", "canonical")
    li = t("lineitem")
    return li.join(canon, li.l_partkey == canon.p_partkey).select("l_orderkey", "l_linenumber", "canonical")


@query("SELECT o_orderkey, l_linenumber, p_name, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT'")
def three_way_join(t):
    o, li, p = t("orders").filter("o_orderpriority = '1-URGENT'"), t("lineitem"), t("part")
    return o.join(li, o.o_orderkey == li.l_orderkey).join(p, p.p_partkey == li.l_partkey).select("o_orderkey", "l_linenumber", "p_name", "l_quantity")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_parent_per_child(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON lower(trim(n_name)) = lower(trim((SELECT n_name FROM nation n2 WHERE n2.n_nationkey = c_nationkey)))")
def expr_key_join(t):
    n = t("nation")
    named = t("customer").join(n, F.col("c_nationkey") == n.n_nationkey).select("c_custkey", F.lower(F.trim("n_name")).alias("artist_norm"))
    return named.join(n, named.artist_norm == F.lower(F.trim(n.n_name))).select("c_custkey", "n_name")


@query("SELECT o_orderkey, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def left_join_enrich(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return t("orders").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_missing(t):
    return t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def semi_join_exists(t):
    s = t("lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return t("supplier").join(s, "s_suppkey", "left_semi").select("s_suppkey")


@query("SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY item_id, w")
def lateral_unnest(t):
    return t("benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w")).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("n"))


@query()
def greedy_one_to_one_match(t):
    """Lines of an order matched to the lines of the next order by part brand, in order, each once."""
    li = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    li = matching.first_of(li, ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    left = li.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("l_ord"), F.col("p_brand").alias("l_key"))
    right = li.select((F.col("l_orderkey") - 1).alias("g"), F.col("l_linenumber").cast("long").alias("r_ord"), F.col("p_brand").alias("r_key"))
    return matching.match_greedily(left, right, "g")


@query(f"""WITH p AS (SELECT *, {_norm('p_name')} AS k FROM part)
SELECT a.p_partkey, b.p_partkey AS match, CAST((a.p_brand = b.p_brand) AS INT) * 100 - abs(a.p_size - b.p_size) AS score
FROM p a JOIN p b ON a.k = b.k AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 12
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY CAST((a.p_brand = b.p_brand) AS INT) * 100 - abs(a.p_size - b.p_size) DESC, b.p_partkey) = 1""")
def best_candidate_match(t):
    """Candidates of an equal normalised name within a band; the best score, first of equals.

    A candidate of the same brand beats all others, one without a brand has no score and comes last.  So each part needs two
    candidates at most of its name, brand and band, and two of its name and band (one of the two may be the part itself):
    they are found once for each name, brand and size, over two keys of each size in the band.
    """
    names = materialize(t("part").select("p_name").distinct().withColumn("k", text.norm(F.col("p_name"))), "part_names")
    p = t("part").dropna(subset=["p_partkey", "p_size"]).join(names, "p_name").select("p_partkey", "k", "p_brand", "p_size")

    def sizes(rows: DataFrame, *keys: str) -> DataFrame:
        """One row for each of ``keys`` and size, with its two smallest part keys."""
        two = matching.top(rows.select(*keys, "p_size", "p_partkey").distinct(), [*keys, "p_size"], 2, F.col("p_partkey"))
        return two.groupBy(*keys, "p_size").agg(F.collect_list("p_partkey").alias("own"))

    def banded(*keys: str, by_gap: bool = True) -> F.Column:
        """The best two candidates within the band around each row of ``sizes``."""
        band = Window.partitionBy(*keys).orderBy("p_size").rangeBetween(-12, 12)
        gap = lambda x: F.abs(x["p_size"] - F.col("p_size")) if by_gap else F.lit(0)
        spread = lambda x: F.transform(x["own"], lambda o: F.struct(gap(x).alias("gap"), o.alias("p_partkey")))
        found = F.array_sort(F.flatten(F.transform(F.collect_list(F.struct("p_size", "own")).over(band), spread)))
        second = lambda v: F.get(F.filter(v, lambda x: x["p_partkey"] != v[0]["p_partkey"]), F.lit(0))
        return F.transform(F.array(found), lambda v: F.array_compact(F.array(v[0], second(v))))[0]  # the list is named, so sorted once

    each = materialize(sizes(p, "k", "p_brand"), "part_sizes")
    keyed = each.select("k", "p_brand", "p_size", F.explode("own").alias("p_partkey"))
    branded = each.select("k", "p_brand", "p_size", F.when(F.col("p_brand").isNotNull(), banded("k", "p_brand")).alias("same"))
    other = sizes(keyed.filter("p_brand is not null"), "k").select("k", "p_size", banded("k").alias("other"))
    unscored = sizes(keyed, "k").select("k", "p_size", banded("k", by_gap=False).alias("unscored"))
    known = branded.join(unscored, ["k", "p_size"]).join(other, ["k", "p_size"], "left").withColumnsRenamed({"k": "_k", "p_brand": "_brand", "p_size": "_size"})
    made = p.join(known, (F.col("k") == F.col("_k")) & F.col("p_brand").eqNullSafe(F.col("_brand")) & (F.col("p_size") == F.col("_size")))

    found = lambda name: F.get(F.filter(name, lambda x: x["p_partkey"] != F.col("p_partkey")), F.lit(0))
    made = made.select("p_partkey", found("same").alias("same"), F.when(F.col("p_brand").isNotNull(), found("other")).alias("other"), found("unscored")["p_partkey"].alias("unscored"))
    score = F.when(F.col("same").isNotNull(), 100 - F.col("same.gap")).when(F.col("other").isNotNull(), -F.col("other.gap"))
    pairs = made.select("p_partkey", F.coalesce("same.p_partkey", "other.p_partkey", "unscored").alias("match"), score.alias("score")).filter("match is not null")
    best = F.max_by(F.struct("match", "score"), F.struct("score", -F.col("match"))).alias("x")  # combines before the shuffle
    return pairs.groupBy("p_partkey").agg(best).select("p_partkey", "x.match", "x.score")


@query("""SELECT a.l_orderkey, a.l_linenumber AS l1, b.l_linenumber AS l2, count(*) AS n, sum(CASE WHEN abs(a.l_quantity - b.l_quantity) <= 3 THEN 1 ELSE 0 END) AS tight
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND abs(a.l_quantity - b.l_quantity) <= 12 GROUP BY ALL""")
def duration_band_match(t):
    li = t("lineitem")
    a, b = li.alias("a"), li.alias("b")
    gap = F.abs(F.col("a.l_quantity") - F.col("b.l_quantity"))
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (gap <= 12)
    return a.join(b, on).groupBy(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("l1"), F.col("b.l_linenumber").alias("l2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(gap <= 3, 1).otherwise(0)).alias("tight")
    )


_TIER = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END"


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, {_TIER} AS tier FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_TIER}, l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) = 1")
def waterfall_pick(t):
    tier = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), 0).when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "O", 2).otherwise(3)
    li = t("lineitem").withColumn("tier", tier)
    return matching.first_of(li, ["l_partkey"], F.col("tier"), F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")).select("l_partkey", "l_orderkey", "l_linenumber", "tier")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued,
 count(*) FILTER (WHERE o_totalprice >= 300000) AS high, count(*) FILTER (WHERE o_totalprice BETWEEN 100000 AND 299999) AS mid,
 count(*) FILTER (WHERE o_totalprice < 100000) AS low, count(*) FILTER (WHERE o_totalprice IS NULL) AS unknown FROM orders""")
def count_filter_matrix(t):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    n = F.count_if
    return t("orders").agg(
        F.count(F.lit(1)).alias("total"), n(s == "F").alias("done"), n(s == "O").alias("queued"), n(p >= 300000).alias("high"),
        n(p.between(100000, 299999)).alias("mid"), n(p < 100000).alias("low"), n(p.isNull()).alias("unknown"),
    )


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def group_count(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2")
def group_two_keys(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("SELECT coalesce(nullif(event_type, 'click'), props->>'k', 'unknown') AS kind, count(*) AS n FROM events GROUP BY 1")
def group_expr_coalesce(t):
    kind = F.coalesce(F.nullif("event_type", F.lit("click")), F.get_json_object("props", "$.k"), F.lit("unknown"))
    return t("events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 50) AS ok, count(*) FILTER (WHERE value < 50) AS failed FROM events GROUP BY event_type")
def pivot_counts_json(t):
    """Counts gathered in one JSON object, and read back from it."""
    n = t("events").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("ok"), F.count_if(F.col("value") < 50).alias("failed"))
    j = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("ok", "failed"))))).alias("j"))
    return j.select(F.explode(F.from_json("j", "map<string,struct<ok:bigint,failed:bigint>>")).alias("event_type", "c")).select("event_type", "c.ok", "c.failed")


@query("SELECT count(*) AS groups, coalesce(sum(brands), 0) AS brands FROM (SELECT p_name, count(DISTINCT lower(trim(p_brand))) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT lower(trim(p_brand))) > 1)")
def duplicate_groups(t):
    g = t("part").groupBy("p_name").agg(F.count_distinct(F.lower(F.trim("p_brand"))).alias("brands")).filter("brands > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("brands"), F.lit(0)).alias("brands"))


@query("SELECT round(coalesce(sum(value), 0), 2) AS total, CAST(coalesce(sum(len(json_keys(props))), 0) AS BIGINT) AS keys, min(ts) AS first, max(ts) FILTER (WHERE event_type = 'click') AS last_click FROM events WHERE value < 90")
def sums_and_bounds(t):
    e = t("events").filter("value < 90")
    return e.agg(
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.coalesce(F.sum(F.size(F.json_object_keys("props"))), F.lit(0)).alias("keys"),
        F.min("ts").alias("first"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_click"),
    )


@query(f"""SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR) AS day_half,
 count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) AS quarter FROM events""")
def recency_counts(t):
    since = lambda x: F.count_if(F.col("ts") >= _as_of() - F.expr(f"INTERVAL {x}"))
    return t("events").agg(since("24 HOURS").alias("day"), since("36 HOURS").alias("day_half"), since("15 MINUTES").alias("quarter"))


@query("""SELECT dup, orphans, bad, dup + orphans + bad AS score, dup + orphans + bad = 0 AS ok FROM (SELECT
 (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS dup,
 (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')) AS orphans,
 (SELECT count(*) FROM lineitem WHERE l_discount > 0.09 OR l_quantity < 1) AS bad)""")
def integrity_audit(t):
    """Critical counters, their sum and the verdict."""
    li = t("lineitem")
    dup = li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count(F.lit(1)).alias("dup"))
    live = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    orphans = li.join(live, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    bad = li.agg(F.count_if((F.col("l_discount") > 0.09) | (F.col("l_quantity") < 1)).alias("bad"))
    score = F.col("dup") + F.col("orphans") + F.col("bad")
    return dup.join(F.broadcast(orphans)).join(F.broadcast(bad)).withColumn("score", score).withColumn("ok", score == 0)  # one row each


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS first FROM events GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type) = 1 AND n >= 2""")
def plurality_with_support(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return matching.first_of(n, ["user_id"], F.desc("n"), F.col("first"), F.col("event_type")).filter("n >= 2").select("user_id", "event_type", "n")


@query("""SELECT o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2) WHERE n >= greatest(2, ceil(0.8 * total))""")
def consensus_threshold(t):
    n = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("total", F.sum("n").over(Window.partitionBy("o_custkey")))
    return total.filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.lit(0.8) * F.col("total")))).select("o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, min(l_suppkey) AS owner FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1 AND count(*) = count(*) FILTER (WHERE l_suppkey IS NOT NULL)")
def unanimous_owner(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("owner"), F.max("l_suppkey").alias("hi"), F.count_if(F.col("l_suppkey").isNull()).alias("none"))
    return g.filter("owner = hi and none = 0").select("l_orderkey", "owner")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS area FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_extendedprice DESC, l_discount DESC, l_linenumber) = 1""")
def argmax_struct(t):
    area = F.col("l_quantity") * F.col("l_extendedprice")
    best = F.max_by(F.struct("l_linenumber", F.round(area, 2).alias("area")), F.struct(area, F.col("l_discount"), -F.col("l_linenumber")))
    return t("lineitem").groupBy("l_orderkey").agg(best.alias("x")).select("l_orderkey", "x.l_linenumber", "x.area")


@query("""SELECT o_custkey, o_orderkey, rn, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') IS NULL, o_orderdate DESC NULLS LAST, md5(CAST(o_orderkey AS VARCHAR))) AS rn,
 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE rn <= 2""")
def row_number_top2_with_group_count(t):
    w = Window.partitionBy("o_custkey")
    missing = F.nullif("o_orderstatus", F.lit("P")).isNull()
    rn = F.row_number().over(w.orderBy(missing, F.desc_nulls_last("o_orderdate"), F.md5(F.col("o_orderkey").cast("string"))))
    return t("orders").select("o_custkey", "o_orderkey", rn.alias("rn"), F.count(F.lit(1)).over(w).alias("n")).filter("rn <= 2")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1")
def first_occurrence_dedup(t):
    return matching.first_of(t("lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_STRATUM = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_totalprice >= 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'recent' ELSE 'simple' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_STRATUM} AS stratum, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, o_orderkey) <= CASE stratum WHEN 'urgent' THEN 15 WHEN 'simple' THEN 5 ELSE 10 END AS q FROM s)
SELECT o_orderkey, stratum FROM r ORDER BY q DESC, h, o_orderkey LIMIT 60""")
def quota_sample(t):
    s = t("orders").withColumn("stratum", F.expr(_STRATUM.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))).withColumn("key", F.col("o_orderkey").cast("string"))
    quotas = {"urgent": 15, "large": 10, "done": 10, "recent": 10, "simple": 5}
    return matching.quota_sample(s, "stratum", F.col("key"), quotas, 60).select("o_orderkey", "stratum")


@query("""SELECT l_partkey, best, second, coalesce(best - second <= 2, false) AS ambiguous FROM (SELECT l_partkey, l_quantity AS best, lead(l_quantity) OVER w AS second, row_number() OVER w AS rn FROM lineitem
 WINDOW w AS (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice)) WHERE rn = 1""")
def ambiguity_lead(t):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_extendedprice")
    r = t("lineitem").select("l_partkey", F.col("l_quantity").alias("best"), F.lead("l_quantity").over(w).alias("second"), F.row_number().over(w).alias("rn")).filter("rn = 1")
    return r.select("l_partkey", "best", "second", F.coalesce(F.col("best") - F.col("second") <= 2, F.lit(False)).alias("ambiguous"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|pilot'), o_orderkey LIMIT 50")
def md5_sample(t):
    return matching.sample(t("orders"), F.col("o_orderkey").cast("string"), "|pilot", 50).select("o_orderkey")


@query("""(SELECT 'top' AS list, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'view' QUALIFY rank <= 3)
UNION ALL (SELECT 'recent', user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 3)""")
def evidence_top_recent(t):
    e = t("events")
    a = matching.top(e.filter("event_type <> 'view'"), ["user_id"], 3, F.desc("value"), F.col("event_id"), rank="rank").withColumn("list", F.lit("top"))
    b = matching.top(e, ["user_id"], 3, F.desc("ts"), F.col("event_id"), rank="rank").withColumn("list", F.lit("recent"))
    return a.unionByName(b).select("list", "user_id", "event_id", "rank")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders),
f AS (SELECT o_custkey, o_orderkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS exact, row_number() OVER (PARTITION BY o_custkey, p <= 6 ORDER BY p) AS parity FROM o WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey, exact <= 2 AS in_exact, p <= 6 AND parity <= 2 AS in_parity FROM f WHERE exact <= 2 OR (p <= 6 AND parity <= 2)""")
def overfetch_limit(t):
    """Two rows a customer after a filter: exactly, and over three times as many fetched before it."""
    w = Window.partitionBy("o_custkey")
    o = t("orders").withColumn("p", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("o_orderstatus = 'F'")
    o = o.withColumn("exact", F.row_number().over(w.orderBy("p"))).withColumn("in_exact", F.col("exact") <= 2)
    o = o.withColumn("in_parity", (F.col("p") <= 6) & (F.col("exact") <= 2))
    return o.filter("in_exact or in_parity").select("o_custkey", "o_orderkey", "in_exact", "in_parity")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) BETWEEN 8 AND 14")
def page_slice(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).filter("rn between 8 and 14").select("o_custkey", "o_orderkey")


@query("""WITH u AS (SELECT 0 AS g, p_partkey, p_size FROM part WHERE p_size <= 2 UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_size BETWEEN 2 AND 4),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY g, p_size) = 1) SELECT p_partkey, p_size FROM f ORDER BY g, p_size, p_partkey LIMIT 20""")
def ordered_union_cap(t):
    p = t("part").select("p_partkey", "p_size")
    return matching.union_capped([p.filter("p_size <= 2"), p.filter("p_size between 2 and 4")], "p_partkey", "p_size", 20).select("p_partkey", "p_size")


@query("SELECT a.p_partkey, len(list_filter(string_split(a.p_name, ' '), lambda x: NOT list_contains(string_split(b.p_name, ' '), x))) AS minus FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def token_set_ops(t):
    p = t("part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", F.size(F.filter(F.split("p_name", " "), lambda x: ~F.array_contains("other", x))).alias("minus"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND starts_with(o_orderpriority, '1') AND contains(lower(o_orderpriority), 'urg') AND regexp_matches(o_orderpriority, '^.-[A-Z]+$')")
def predicate_pack(t):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t("orders").filter(~s.eqNullSafe("F") & p.isin("1-URGENT", "2-HIGH") & p.startswith("1") & p.ilike("%urg%") & p.rlike("^.-[A-Z]+$")).select("o_custkey", "o_orderkey")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE starts_with(url, 'http') AND regexp_matches(url, '^https?://[^/]*\\.(net|org)(/|$)')")
def url_allow_list(t):
    host = F.parse_url("url", F.lit("HOST"))
    return t("pages").filter(F.startswith("url", F.lit("http")) & host.rlike(r"\.(net|org)$")).select("page_id", host.alias("host"))


@query("SELECT p_partkey, coalesce(n, p_size) AS size FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_quantity) AS INT) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def update_from_backfill(t):
    n = t("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("n"))
    return t("part").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", "p_size").alias("size"))


@query(f"""WITH last AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) FILTER (WHERE seen IS NULL OR seen < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY) AS stale FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN last USING (user_id)""")
def stale_children(t):
    e = t("events")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return e.select("user_id").distinct().join(last, "user_id", "left").agg(F.count_if(F.col("seen").isNull() | (F.col("seen") < _as_of() - F.expr("INTERVAL 10 DAYS"))).alias("stale"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
 LEFT JOIN (SELECT o_custkey, o_orderkey AS last FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) b ON b.o_custkey = c_custkey""")
def entity_assembly(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return t("customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last")


@query("SELECT item_id, pos, w FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark)")
def position_explode(t):
    return t("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("p", "w")).select("item_id", (F.col("p") + 1).cast("long").alias("pos"), "w")


@query("""WITH a AS (SELECT min(p_partkey) AS canonical, p_name FROM part GROUP BY p_name) SELECT l_orderkey, canonical FROM lineitem JOIN part ON p_partkey = l_partkey JOIN a USING (p_name)
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, canonical ORDER BY l_linenumber) = 1""")
def canonical_dedup(t):
    p = t("part")
    canon = p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("canonical")), "p_name").select(F.col("p_partkey").alias("l_partkey"), "canonical")
    return t("lineitem").join(canon, "l_partkey").select("l_orderkey", "canonical").distinct()


@query("SELECT event_id, value FROM (SELECT event_id, value, 1 AS s FROM events UNION ALL SELECT event_id, value + 1, 2 FROM events WHERE event_type = 'click') QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s DESC) = 1")
def latest_by_id_union(t):
    e = t("events").select("event_id", "value")
    edits = t("events").filter("event_type = 'click'").select("event_id", (F.col("value") + 1).alias("value"))
    return e.withColumn("s", F.lit(1)).unionByName(edits.withColumn("s", F.lit(2))).groupBy("event_id").agg(F.max_by("value", "s").alias("value"))


@query("SELECT s_nationkey, max(s_acctbal) AS best FROM supplier GROUP BY 1 HAVING count(*) >= 3 ORDER BY md5(CAST(s_nationkey AS VARCHAR)) LIMIT 5")
def having_md5_limit(t):
    g = t("supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return g.orderBy(F.md5(F.col("s_nationkey").cast("string"))).limit(5).select("s_nationkey", "best")


@query("SELECT l_shipmode, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_shipmode LIMIT 10")
def reason_histogram(t):
    return t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_shipmode").limit(10)


@query("SELECT event_type, arg_min(event_id, ts) AS lane, round(count(*) * 60000.0 / nullif(epoch_ms(max(ts)) - epoch_ms(min(ts)), 0), 1) AS per_minute FROM events GROUP BY 1")
def argmin_lane_throughput(t):
    ms = (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).cast("long")
    rate = F.round(F.count(F.lit(1)) * F.lit(60000.0) / F.nullif(ms, F.lit(0)), 1)
    return t("events").groupBy("event_type").agg(F.min_by("event_id", "ts").alias("lane"), rate.alias("per_minute"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'hybrid' END AS source, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def source_label_pivot(t):
    g = t("lineitem").groupBy("l_orderkey")
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    return g.agg(F.when(F.min("l_returnflag") == F.max("l_returnflag"), F.min("l_returnflag")).otherwise("hybrid").alias("source"), n("A").alias("a"), n("N").alias("n"), n("R").alias("r"))


@query("SELECT s_suppkey, nullif(s_nationkey, 3) AS nation, row_number() OVER (ORDER BY nullif(s_nationkey, 3) NULLS LAST, s_acctbal DESC, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 30")
def nulls_last_order(t):
    s = t("supplier").withColumn("nation", F.nullif("s_nationkey", F.lit(3))).orderBy(F.asc_nulls_last("nation"), F.desc("s_acctbal"), "s_suppkey").limit(30)
    w = Window.orderBy(F.asc_nulls_last("nation"), F.desc("s_acctbal"), "s_suppkey")  # 30 rows
    return s.select("s_suppkey", "nation", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topn_desc(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT user_id FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS checked FROM events GROUP BY 1) ORDER BY coalesce(checked, TIMESTAMP '1970-01-01'), user_id LIMIT 5")
def never_checked_first(t):
    c = t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("checked"))
    return c.orderBy(F.coalesce("checked", F.lit("1970-01-01").cast("timestamp_ntz")), "user_id").limit(5).select("user_id")
