"""Decisions of catalog resolution over whole tables: identity in context, transfers, recovery, queues, search, metadata."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinwork.functions import decisions as d
from skeinwork.functions import documents, text
from skeinwork.plans.base import Catalogue

catalogue = Catalogue()
query = catalogue.query
_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN p_brand = p_type ELSE false END AS matches,
 p_partkey % 2 = 0 AS credited, (p_partkey % 4 < 2) OR p_partkey % 2 = 0 AS belongs FROM part""")
def credit_context(t):
    """Credits of two names against the artist of a page, and featuring clauses of titles (R-01, R-03, R-04)."""
    k = F.col("p_partkey") % 4
    credit = F.concat_ws(" & ", "p_brand", "p_type")
    page = F.when(k == 0, F.col("p_type")).when(k == 1, F.lower(credit)).when(k == 2, F.concat_ws(" & ", "p_type", F.lit("Someone Else"))).otherwise(F.lit("Nobody"))
    guest = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit("Nobody"))
    title = F.concat(F.initcap("p_name"), F.lit(" (feat. "), "p_type", F.lit(")"))
    context = F.when(k < 2, F.col("p_brand")).otherwise(guest)
    return t("part").select("p_partkey", d.credit_in_context(credit, page).alias("matches"), d.title_credits(title, guest).alias("credited"), d.belongs_to(F.col("p_brand"), title, context).alias("belongs"))


@query(f"""WITH r AS (SELECT p_brand, {_NORM.format('p_brand')} AS target, p_size % 50 = 7 AS inferred, CASE WHEN p_size % 50 = 9 THEN p_name ELSE p_brand || ' ' || p_name END AS raw FROM part)
SELECT p_brand, bool_and(NOT inferred AND starts_with({_NORM.format('raw')}, target || ' ')) AS trusted, count(*) FILTER (WHERE inferred) AS inferred FROM r GROUP BY p_brand""")
def legacy_lists(t):
    """Lists of which every row names its artist first and infers none (P-21, F-10)."""
    title = F.when(F.col("p_size") % 50 == 7, F.concat("p_name", F.lit(" feat "), "p_brand")).otherwise(F.col("p_name"))
    raw = F.when(F.col("p_size") % 50 == 9, F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    rows = t("part").select("p_brand", d.artist_was_inferred(F.col("p_brand"), title).alias("inferred"), F.startswith(text.norm(raw), F.concat(text.norm(F.col("p_brand")), F.lit(" "))).alias("first"))
    return rows.groupBy("p_brand").agg(F.bool_and(~F.col("inferred") & F.col("first")).alias("trusted"), F.count_if("inferred").alias("inferred"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status, CAST(floor(o_totalprice * 300) AS BIGINT) AS size,
 CASE o_orderkey % 3 WHEN 0 THEN 'Text/Plain; charset=utf-8' WHEN 1 THEN 'audio/mp4' END AS kind FROM orders),
r AS (SELECT *, CASE WHEN status IS NULL THEN 'HTTP unknown' WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status WHEN size > 51380224 THEN 'file too large: ' || size END AS reason FROM m)
SELECT o_orderkey, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN lower(split_part(kind, ';', 1)) END AS content_type, CASE WHEN reason IS NULL THEN coalesce(kind LIKE 'Text/%', false) END AS suspicious FROM r""")
def http_meta_check(t):
    """Heads of responses: status, size, and types that do not look like sound (P-23)."""
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, 404).when(key % 5 == 1, F.lit(None).cast("int")).otherwise(200)
    kind = F.when(key % 3 == 0, "Text/Plain; charset=utf-8").when(key % 3 == 1, "audio/mp4")
    return t("orders").select("o_orderkey", d.http_meta(status, kind, F.floor(F.col("o_totalprice") * 300)).alias("m")).select("o_orderkey", "m.*")


@query("""SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS missing,
 count(*) FILTER (WHERE l_returnflag = 'R') > 2 AND count(*) FILTER (WHERE l_returnflag = 'R') >= 0.35 * count(*) AS bulk FROM lineitem GROUP BY l_orderkey""")
def bulk_or_sparse(t):
    """Whether an order's missing lines are asked for at once (F-46)."""
    made = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("missing"))
    return made.withColumn("bulk", d.uses_bulk(F.col("total"), F.col("missing")))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY k) FILTER (WHERE k <= 3) AS attempt, greatest(count(*) - 3, 0) AS skipped FROM n GROUP BY l_orderkey""")
def recovery_split(t):
    """The first three lines of an order are tried, the rest is skipped (R-26)."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    split = d.bounded(F.transform("lines", lambda x: x["l_partkey"].cast("string")), 3)
    return lines.select("l_orderkey", split.alias("s")).select("l_orderkey", F.array_join("s.attempt", ",").alias("attempt"), F.col("s.skipped").cast("long").alias("skipped"))


@query(f"""WITH x AS (SELECT {_NORM.format('p_brand')} AS key, p_brand AS name, 1 AS explicit, p_partkey FROM part WHERE p_size % 5 <> 0
  UNION ALL SELECT {_NORM.format('p_type')}, p_type, 0, p_partkey FROM part)
SELECT key, arg_max(name, CASE WHEN explicit = 1 THEN p_partkey ELSE -1 - p_partkey END) AS name, max(explicit) = 1 AS explicit,
 CASE WHEN max(explicit) = 1 THEN max(p_partkey) FILTER (WHERE explicit = 1) END AS seed FROM x GROUP BY key""")
def artist_seeding(t):
    """Artists of tracks and of featuring clauses: the last explicit track of a name wins, else its first clause (A-27)."""
    title = F.concat("p_name", F.lit(" (feat. "), "p_type", F.lit(")"))
    rows = t("part").withColumn("own", F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))).withColumn("guests", text.featured_credits(title))
    own = rows.filter("own is not null").select(F.col("own").alias("name"), F.lit(True).alias("explicit"), "p_partkey")
    guests = rows.select(F.explode("guests").alias("name"), F.lit(False).alias("explicit"), "p_partkey")
    named = own.unionByName(guests).withColumn("key", text.norm(F.col("name"))).filter("key <> ''")
    rank = F.struct("explicit", F.when(F.col("explicit"), F.col("p_partkey")).otherwise(-1 - F.col("p_partkey")))
    best = named.groupBy("key").agg(F.max_by(F.struct("name", "explicit", "p_partkey"), rank).alias("b"))
    return best.select("key", "b.name", "b.explicit", F.when(F.col("b.explicit"), F.col("b.p_partkey")).alias("seed"))


@query("""SELECT event_id, sha256(event_id || chr(30) || event_type || chr(30) || event_type || chr(31) || user_id || chr(30) || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'doc:' || user_id END || chr(30)) AS revision FROM events""")
def message_revision(t):
    """Fingerprints of message revisions (F-29)."""
    media = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("doc:"), F.col("user_id").cast("string")))
    made = d.message_fingerprint(F.col("event_id"), F.col("event_type"), F.array("event_type", F.col("user_id").cast("string")), media, F.lit(None).cast("string"))
    return t("events").select("event_id", F.sha2(made, 256).alias("revision"))


@query("""WITH m AS (SELECT p_partkey, p_size * 10 AS want, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 10 + p_partkey % 30 - 5 END AS got, p_partkey % 7 = 0 AS video, p_partkey % 13 = 0 AS nameless,
 CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS title_ok FROM part)
SELECT p_partkey, NOT video AND NOT nameless AND coalesce(title_ok, true) AND (want = 0 OR got = 0 OR abs(want - got) <= 12) AS ok, NOT nameless AND p_partkey % 2 = 0 AS same_file,
 CASE WHEN want <> 0 AND got <> 0 THEN abs(want - got) END AS off FROM m""")
def transfer_evaluation(t):
    """Returned files against asked rows: sound, named, about as long, not contradicted (R-29)."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    got = F.when(key % 11 == 0, 0).otherwise(size * 10 + key % 30 - 5)
    file_id = F.when(key % 13 == 0, "").otherwise(key.cast("string"))
    asked = F.when(key % 2 == 0, file_id).otherwise("other")
    title_ok = F.when(key % 4 == 0, False).when(key % 4 == 1, True)
    kind = F.when(key % 7 == 0, "video").otherwise("audio")
    return t("part").select("p_partkey", d.transfer(size * 10, got, kind, file_id, asked, title_ok, F.lit(None).cast("boolean")).alias("m")).select("p_partkey", "m.*")


@query("""WITH l AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'BUILDING', 'FURNITURE', c_mktsegment, c_name], lambda x: x IS NOT NULL) AS l FROM customer)
SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS candidates FROM l""")
def candidate_union(t):
    """Prepared candidates, then guessed ones, each once (X-03)."""
    prepared = F.array(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    guessed = F.array(F.lit("BUILDING"), F.lit("FURNITURE"), "c_mktsegment", "c_name")
    return t("customer").select("c_custkey", F.array_join(d.ordered_union(prepared, guessed), "|").alias("candidates"))


@query("""WITH c AS (SELECT p_brand, max(CAST(list_contains(string_split(p_name, ' '), 'cold') AS INT) + CAST(list_contains(string_split(p_name, ' '), 'widget') AS INT)) AS best FROM part GROUP BY p_brand)
SELECT p_brand, best, best >= 2 AS accepted, best < 2 AS fallback FROM c""")
def shortened_search(t):
    """Best coverage of a two-word query by each brand, and what follows from it (A-19, R-18, R-19)."""
    wanted = F.array(F.lit("cold"), F.lit("widget"))
    best = t("part").groupBy("p_brand").agg(F.max(F.size(F.array_intersect(wanted, F.split("p_name", " ")))).alias("best"))
    two, never = F.size(wanted), F.lit(False)
    return best.select("p_brand", "best", d.accepts_shortened(never, two, F.col("best")).alias("accepted"), d.needs_fallback(two, F.col("best"), never, F.lit(0)).alias("fallback"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(left(o_orderpriority, 1) AS INT) DESC, o_orderkey) AS place FROM orders")
def priority_fifo(t):
    """Places in a queue per customer: higher priority first, then first come (O-10)."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc(F.left("o_orderpriority", F.lit(1)).cast("int")), "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(order).alias("place"))


@query("""WITH s AS (SELECT p_partkey AS source_url, p_name AS title, p_brand AS artist, CASE WHEN p_size % 4 > 0 THEN CAST(round(p_retailprice / 8) AS INT) END AS seconds, CASE WHEN p_size % 6 = 0 THEN '  ' ELSE p_type END AS slug FROM part),
g AS (SELECT source_url, title, artist, seconds FROM s WHERE trim(slug) <> ''),
o AS (SELECT p_partkey AS source_url, 'old' AS title, 'old' AS artist, 1 AS seconds FROM part WHERE p_partkey % 3 = 0)
SELECT * FROM g UNION ALL SELECT * FROM o WHERE source_url NOT IN (SELECT source_url FROM g)""")
def cache_seeding(t):
    """Rows seeded from a select with blanks filtered and lengths rounded, over the rows there are (M-18)."""
    slug = F.when(F.col("p_size") % 6 == 0, "  ").otherwise(F.col("p_type"))
    new = t("part").filter(F.trim(slug) != "").select(
        F.col("p_partkey").alias("source_url"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(F.col("p_size") % 4 > 0, F.round(F.col("p_retailprice") / 8)).cast("int").alias("seconds")
    )
    old = t("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("source_url"), F.lit("old").alias("title"), F.lit("old").alias("artist"), F.lit(1).alias("seconds"))
    return new.unionByName(old.join(new.select("source_url"), "source_url", "left_anti"))


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS INT) = 10")
def json_containment(t):
    """Events whose properties contain a given object (P-09)."""
    return t("events").filter(documents.contains(F.col("props"), {"k": 10})).select("event_id")


#: What an event's document is asked for, and the same by paths and types.
_WANTED = {
    "is_true": ('{"big":true}', "json_type(doc, '$.big') = 'BOOLEAN' AND doc->>'$.big' = 'true'"),
    "text_10": ('{"k":"10"}', "json_type(doc, '$.k') = 'VARCHAR' AND doc->>'$.k' = '10'"),
    "number_10": ('{"k":10}', "json_type(doc, '$.k') IN ('UBIGINT', 'BIGINT') AND doc->>'$.k' = '10'"),
    "nested": ('{"in":{"kind":"view"}}', "doc->>'$.in.kind' = 'view'"),
    "items": ('{"tags":["click"]}', "list_contains(CAST(doc->'$.tags' AS VARCHAR[]), 'click')"),
    "both": ('{"big":false,"in":{"kind":"error","none":null}}', "doc->>'$.big' = 'false' AND doc->>'$.in.kind' = 'error' AND json_type(doc, '$.in.none') = 'NULL'"),
    "none": ('{"in":{"none":null}}', "json_type(doc, '$.in.none') = 'NULL'"),
    "deep": ('{"rows":[{"big":true}]}', "doc->>'$.rows[0].big' = 'true'"),
    "every": ("{}", "true"),
}


@query("WITH e AS (SELECT event_id, to_json({'k': CAST(props->>'k' AS BIGINT), 'big': value > 50, 'tags': [event_type, 'x'], 'rows': [{'big': value > 20}], 'in': {'kind': event_type, 'none': NULL}}) AS doc FROM events) SELECT event_id, "
       + ", ".join(f"({x}) AS {n}" for n, (_, x) in _WANTED.items()) + " FROM e")
def json_containment_typed(t):
    """Containment of booleans, texts, numbers, nested objects, arrays and nulls (P-09, F-87)."""
    doc = F.format_string(
        '{"k":%s,"big":%s,"tags":["%s","x"],"rows":[{"big":%s}],"in":{"kind":"%s","none":null}}', F.get_json_object("props", "$.k"), (F.col("value") > 50).cast("string"), "event_type", (F.col("value") > 20).cast("string"), "event_type"
    )
    return t("events").select("event_id", doc.alias("doc")).select("event_id", *(documents.contains(F.col("doc"), json.loads(x)).alias(n) for n, (x, _) in _WANTED.items()))


@query("""WITH e AS (SELECT event_id, event_type AS kind, CAST(props->>'k' AS BIGINT) AS k, user_id % 2 = 0 AS own, event_id % 2 = 0 AS same, value > 50 AS big FROM events)
SELECT event_id, '{"k":' || CASE WHEN big THEN 'null' ELSE CAST(k + 1 AS VARCHAR) END || ',"kind":"' || kind || '","n":1,"rawText":"' || CASE WHEN own AND NOT same THEN 'old' ELSE 'new' END || '","source":"' || CASE WHEN own THEN 'live' WHEN same THEN 'live' ELSE 'web' END || '"}' AS merged,
 CASE WHEN kind = 'click' THEN '{"k":' || k || ',"kind":"click"}' WHEN kind = 'view' THEN '{"id":' || k || '}' WHEN kind = 'error' THEN NULL ELSE '{"id":' || k || ',"result":0}' END AS record,
 CASE WHEN big THEN '{"caps":{},"k":' || k || '}' ELSE '{"k":' || k || '}' END AS patched FROM e""")
def json_documents(t):
    """Documents of a preferred source merged with others', payloads unwrapped, a field replaced where there is one (F-82, F-83, F-88)."""
    e = t("events").withColumn("k", F.get_json_object("props", "$.k"))
    source = lambda c: F.when(c, "live").otherwise("web")
    big = F.col("value") > 50
    old = F.format_string('{"source":"%s","rawText":"old","k":%s,"kind":"%s"}', source(F.col("user_id") % 2 == 0), "k", "event_type")
    new = F.format_string('{"rawText":"new","source":"%s","n":1,"k":%s}', source(F.col("event_id") % 2 == 0), F.when(big, "null").otherwise((F.col("k").cast("long") + 1).cast("string")))
    payload = F.when(F.col("event_type") == "click", F.format_string('{"kind":"click","k":%s}', "k")).when(F.col("event_type") == "view", F.format_string('{"data":0,"result":[null,"",0,{"id":%s},1]}', "k"))
    payload = payload.when(F.col("event_type") == "error", F.lit("[false, 0]")).otherwise(F.format_string('{"track":"x","data":{"result":0,"id":%s}}', "k"))
    doc = F.when(big, F.format_string('{"k":%s,"caps":{"a":1}}', "k")).otherwise(F.format_string('{"k":%s}', "k"))
    return e.select(
        "event_id", documents.merged_provenance(old, new, "live").alias("merged"), documents.unwrapped(payload).alias("record"), documents.with_field(doc, "caps", F.lit("{}"), create=False).alias("patched")
    )


@query(f"""WITH p AS (SELECT p_brand, p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' !' ELSE '' END AS title, p_size AS n, p_retailprice > 920 AS verified, p_partkey % 2 = 0 AS known FROM part),
k AS (SELECT *, {_NORM.format('title')} AS key FROM p),
f AS (SELECT p_brand, count(*) % 2 = 0 AS is_full, count(*) FILTER (WHERE NOT known) AS seen FROM k GROUP BY 1),
g AS (SELECT k.* FROM k JOIN f USING (p_brand) WHERE (seen = 0 AND known) OR (seen > 0 AND is_full AND NOT known AND verified) OR (seen > 0 AND NOT is_full AND (known OR verified))),
o AS (SELECT p_brand, key, min((NOT known, p_partkey)) AS place, arg_max(title || ':' || n, (NOT known, p_partkey)) AS item FROM g JOIN f USING (p_brand) WHERE NOT is_full AND seen > 0 GROUP BY 1, 2
  UNION ALL SELECT p_brand, key, (NOT known, p_partkey), title || ':' || n FROM g JOIN f USING (p_brand) WHERE is_full OR seen = 0)
SELECT f.p_brand, coalesce(string_agg(item, '|' ORDER BY place), '') AS items FROM f LEFT JOIN o ON o.p_brand = f.p_brand GROUP BY f.p_brand""")
def list_merge(t):
    """Lists of a brand merged with what was seen of it: partly, in full, or not at all (M-17)."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " !").otherwise(""))
    p = t("part").select("p_brand", "p_partkey", F.struct(title.alias("title"), F.col("p_size").alias("n"), (F.col("p_retailprice") > 920).alias("verified")).alias("item"), (F.col("p_partkey") % 2 == 0).alias("known"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("p_partkey", "item")))), lambda x: x["item"])
    g = p.groupBy("p_brand").agg(listed(F.col("known")).alias("known"), listed(~F.col("known")).alias("seen"), (F.count(F.lit(1)) % 2 == 0).alias("full"))
    seen = F.when(F.size("seen") > 0, F.col("seen"))
    made = documents.merged_list(F.col("known"), seen, F.col("full"), lambda x: x["verified"])
    return g.select("p_brand", F.array_join(F.transform(made, lambda x: F.concat_ws(":", x["title"], x["n"])), "|").alias("items"))


@query("""SELECT l_orderkey, json_array_length(to_json(list(l_partkey))) AS n, json_type(to_json(list(l_partkey))) = 'ARRAY' AS is_array FROM lineitem GROUP BY l_orderkey""")
def json_array_sizes(t):
    """Lengths of JSON arrays; anything else has none (F-85)."""
    listed = t("lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("j"))
    return listed.select("l_orderkey", F.json_array_length("j").cast("long").alias("n"), F.json_array_length("j").isNotNull().alias("is_array"))


#: Tables whose columns are listed.
_LISTED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "nation": "n_nationkey n_name n_regionkey", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "region": "r_regionkey r_name"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, {k} AS place, count(*) AS n_rows, count({c}) AS n_filled FROM {n}" for n, x in _LISTED.items() for k, c in enumerate(x.split(), 1)))
def catalog_columns(t):
    """Columns of tables by name and place, with their rows and how many are filled (S-12)."""
    made = None
    for name in _LISTED:
        df = t(name)
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("place"), F.count(c).alias("n_filled")) for k, c in enumerate(df.columns, 1))).alias("c"))
        rows = counts.select(F.lit(name).alias("table_name"), "n_rows", F.inline("c"))
        made = rows if made is None else made.unionByName(rows)
    return made
