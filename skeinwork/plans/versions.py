"""Write semantics and the work queue: the next version of a table as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import merge, tasks
from skeinwork.plans.base import AS_OF, Catalogue

catalogue = Catalogue()
query = catalogue.query

# existing: orders whose key leaves no remainder by 2 or 3; incoming: those that leave none by 3 or 5, altered
_E = "(SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, CAST(1 AS BIGINT) AS c FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"
_I = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 15 = 0 THEN 'unknown' ELSE lower(o_orderstatus) END AS s, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice + 1 END AS p, CAST(2 AS BIGINT) AS c FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)"


def _sides(t):
    o = t("orders")
    k = F.col("o_orderkey")
    e = o.filter((k % 2 == 0) | (k % 3 == 0)).select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), F.lit(1).cast("long").alias("c"))
    i = o.filter((k % 3 == 0) | (k % 5 == 0)).select(
        k.alias("k"), F.when(k % 15 == 0, "unknown").otherwise(F.lower("o_orderstatus")).alias("s"), F.when(k % 9 == 0, None).otherwise(F.col("o_totalprice") + 1).alias("p"), F.lit(2).cast("long").alias("c")
    )
    return e, i


def _full(s: str, p: str, c: str) -> str:
    both = "e.k IS NOT NULL AND i.k IS NOT NULL"
    pick = lambda x, rule: f"CASE WHEN {both} THEN {rule} WHEN e.k IS NULL THEN i.{x} ELSE e.{x} END AS {x}"
    return f"SELECT coalesce(e.k, i.k) AS k, {pick('s', s)}, {pick('p', p)}, {pick('c', c)} FROM {_E} e FULL JOIN {_I} i ON e.k = i.k"


@query(_full("i.s", "i.p", "i.c"))
def upsert_overwrite(t):
    return merge.upsert(*_sides(t), ["k"], {})


@query(_full("CASE WHEN i.s <> 'unknown' THEN i.s ELSE e.s END", "coalesce(i.p, e.p)", "greatest(e.c, i.c)"))
def upsert_new_else_old(t):
    return merge.upsert(*_sides(t), ["k"], {"s": merge.when_known(), "p": merge.new_else_old, "c": merge.greatest})


@query(_full("e.s", "coalesce(e.p, i.p)", "least(e.c, i.c)"))
def upsert_old_else_new(t):
    return merge.upsert(*_sides(t), ["k"], {"s": merge.old, "p": merge.old_else_new, "c": merge.least})


@query(_full("i.s", "coalesce(i.p, e.p)", "e.c + i.c"))
def upsert_counter(t):
    return merge.upsert(*_sides(t), ["k"], {"p": merge.new_else_old, "c": merge.add})


@query(_full("CASE WHEN e.s <> 'F' THEN i.s ELSE e.s END", "CASE WHEN e.s <> 'F' THEN i.p ELSE e.p END", "CASE WHEN e.s <> 'F' THEN i.c ELSE e.c END"))
def upsert_guarded(t):
    return merge.upsert(*_sides(t), ["k"], {}, guard=lambda e, i: F.col("e.s") != "F")


@query(f"SELECT * FROM {_E} UNION ALL SELECT * FROM {_I} WHERE k NOT IN (SELECT k FROM {_E})")
def insert_ignore(t):
    e, i = _sides(t)
    return merge.insert_ignore(e, i, ["k"])


_QUEUE = "CASE WHEN e.s IN ('O', 'P') THEN 'queued' ELSE e.s END"


@query(_full(_QUEUE, "least(e.p, i.p)", "CASE WHEN e.s = 'P' THEN 0 ELSE e.c END"))
def queue_upsert(t):
    """Failed (P) and queued (O) tasks are queued again, failed ones with no attempts; done ones stay."""
    revive = lambda old, new: F.when(old.isin("O", "P"), "queued").otherwise(old)
    e, i = _sides(t)
    attempts = lambda old, new: F.when(F.col("e.s") == "P", F.lit(0)).otherwise(old)
    return merge.upsert(e, i, ["k"], {"s": revive, "p": merge.least, "c": attempts})


@query(_full("CASE WHEN e.s = 'F' THEN e.s ELSE 'pending' END", "CASE WHEN e.s = 'F' THEN e.p END", "CASE WHEN e.c IS DISTINCT FROM i.c AND e.s <> 'F' THEN i.c ELSE e.c END"))
def versioned_reset(t):
    """Rows of another version start again, successes stay."""
    done = F.col("e.s") == "F"
    rules = {
        "s": lambda old, new: F.when(done, old).otherwise("pending"),
        "p": lambda old, new: F.when(done, old),
        "c": lambda old, new: F.when(~old.eqNullSafe(new) & ~done, new).otherwise(old),
    }
    return merge.upsert(*_sides(t), ["k"], rules)


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_partkey + 1 FROM lineitem WHERE l_orderkey % 4 = 0 AND l_quantity > 25 UNION ALL SELECT l_orderkey, l_partkey FROM lineitem l WHERE l_orderkey % 4 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_quantity > 25)")
def list_replace(t):
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    incoming = li.filter("l_orderkey % 4 = 0 and l_quantity > 25").select("l_orderkey", (F.col("l_partkey") + 1).alias("l_partkey"))
    return merge.replace_lists(li.drop("l_quantity"), incoming, ["l_orderkey"])


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def toggle_parity(t):
    return merge.toggled(t("events"), ["user_id", "event_type"])


@query("""SELECT p_partkey, rn = 1 AS active, CASE WHEN rn > 1 THEN head END AS superseded_by FROM (SELECT p_partkey, row_number() OVER w AS rn, first_value(p_partkey) OVER w AS head FROM part
 WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey))""")
def supersede_family(t):
    rows = t("part").withColumn("key", F.col("p_partkey"))
    return merge.supersede(rows, ["p_brand", "p_name"], F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", "active", "superseded_by")


_TASKS = "(SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS priority, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'failed' ELSE 'queued' END AS status, ts AS available_at, ts + INTERVAL 1 MINUTE AS started_at, CAST(event_id % 4 AS BIGINT) AS attempts FROM events)"


def _tasks(t):
    kind = F.col("event_type")
    status = F.when(kind == "click", "running").when(kind == "purchase", "failed").otherwise("queued")
    return t("events").select(
        F.col("event_id").alias("id"), F.floor("value").alias("priority"), status.alias("status"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("started_at"), (F.col("event_id") % 4).alias("attempts")
    )


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(f"SELECT id, priority + least(60, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(available_at))) / 600) AS BIGINT)) AS rank_priority FROM {_TASKS} WHERE status = 'queued' AND available_at <= TIMESTAMP '{AS_OF}' ORDER BY rank_priority DESC, available_at, id LIMIT 100")
def aged_priority_claim(t):
    return tasks.claim(_tasks(t), _as_of(), 100).select("id", "rank_priority")


@query(f"SELECT id, CASE WHEN status = 'running' AND epoch(TIMESTAMP '{AS_OF}') - floor(epoch(started_at)) > 864000 THEN 'queued' ELSE status END AS status FROM {_TASKS}")
def stale_recovery(t):
    return tasks.recover(_tasks(t), _as_of(), 864000).select("id", "status")


@query(f"SELECT id, CASE WHEN attempts < 3 OR id % 7 = 0 THEN 'retry' ELSE 'failed' END AS status, CASE WHEN id % 7 = 0 THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts FROM {_TASKS} WHERE status = 'failed'")
def status_transition(t):
    f = _tasks(t).filter("status = 'failed'")
    status, left = tasks.failed(F.col("status"), F.col("attempts"), F.col("id") % 7 == 0, 3)
    return f.select("id", status.alias("status"), left.alias("attempts"))


@query(f"SELECT id FROM {_TASKS} WHERE NOT (status = 'failed' AND available_at < TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY)")
def retention_delete(t):
    return _tasks(t).filter(~((F.col("status") == "failed") & (F.col("available_at") < _as_of() - F.expr("INTERVAL 21 DAYS")))).select("id")


@query(f"SELECT id, status = 'failed' OR (status = 'running' AND epoch(TIMESTAMP '{AS_OF}') - floor(epoch(started_at)) > 864000) OR (status = 'queued' AND attempts = 0) AS ready FROM {_TASKS}")
def readiness_predicate(t):
    status = F.when(F.col("status") == "failed", "retry").when(F.col("status") == "running", "processing").when(F.col("attempts") == 0, "pending").otherwise("done")
    return _tasks(t).select("id", tasks.ready(status, F.col("available_at"), F.col("started_at"), _as_of(), 864000).alias("ready"))


@query(f"SELECT id, CASE WHEN status = 'queued' AND EXISTS (SELECT 1 FROM {_TASKS} b WHERE b.status = 'running' AND b.id % 500 = a.id % 500) THEN 'superseded' ELSE status END AS status FROM {_TASKS} a")
def compaction(t):
    """Queued tasks give way to a running bundle of the same group."""
    a = _tasks(t).withColumn("g", F.col("id") % 500)
    bundle = a.filter("status = 'running'").select("g").distinct().withColumn("has", F.lit(True))
    status = F.when((F.col("status") == "queued") & F.col("has"), "superseded").otherwise(F.col("status"))
    return a.join(bundle, "g", "left").select("id", status.alias("status"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice > 100000)) GROUP BY 1")
def cascade_delete(t):
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    _, left = merge.delete_cascade(o, t("lineitem"), "l_orderkey", (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000))
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS k, p_name AS name, NULL::VARCHAR AS extra FROM part UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def additive_migration(t):
    a = t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return merge.add_columns(a, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("extra")))
