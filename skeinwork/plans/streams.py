"""Event-time queries: batch forms, and a stream drained over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwork.operators import matching
from skeinwork.plans.base import Catalogue
from skeinwork.streaming import events as ev
from skeinwork.streaming import folds, keyed, ordered, sinks

catalogue = Catalogue()
query = catalogue.query


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 1800 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s GROUP BY user_id, session""")
def session_gap(t):
    return ev.sessions(t("events"), "user_id", "ts", 1800)


@query("SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def latest_by_key(t):
    return ev.latest(t("events"), "user_id", "ts", "event_type")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 30")
def bounded_buffer(t):
    return ev.newest_n(t("events"), "user_id", "event_id", 30).select("user_id", "event_id", "place")


@query("SELECT DISTINCT event_type, user_id, CAST(floor(floor(epoch(ts)) / 7200) AS BIGINT) AS bucket FROM events")
def dedup_bucket(t):
    return ev.once_a_bucket(t("events"), ["event_type", "user_id"], "ts", 7200)


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT u, ts, event_id, k, ts AS last, true AS accepted FROM e WHERE k = 1
  UNION ALL SELECT e.u, e.ts, e.event_id, e.k, CASE WHEN e.ts - s.last >= INTERVAL 3600 SECOND THEN e.ts ELSE s.last END, e.ts - s.last >= INTERVAL 3600 SECOND FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1)
SELECT u AS user_id, ts, event_id, accepted FROM s""")
def rate_limit_fold(t):
    return matching.cooldown(t("events").select("user_id", "ts", "event_id"), "user_id", "ts", 3600)


def _stream(spark, sf_dir):
    """The events of a file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _live(name: str):
    """Register a function of (spark, sf_dir) whose rows are those of the query ``name`` without "_stream"."""

    def keep(f):
        catalogue.queries[f.__name__] = f
        catalogue.sql[f.__name__] = catalogue.sql[name]
        return f

    return keep


@_live("latest_by_key")
def latest_by_key_stream(spark, sf_dir):
    """The newest event type of every user, upserted by a stream (T-03, S-13)."""
    rows = _stream(spark, sf_dir).select("user_id", "ts", "event_type")
    return sinks.drain_upserts(rows, "latest", ["user_id"], F.col("ts")).select("user_id", "event_type")


@_live("dedup_bucket")
def stream_dedup_bucket(spark, sf_dir):
    """Distinct (type, user, bucket) of a stream: the table of those seen is the only state (T-08)."""
    rows = _stream(spark, sf_dir).select("event_type", "user_id", ev.bucket("ts", 7200).alias("bucket_no"))
    return sinks.drain_upserts(rows, "buckets", ["event_type", "user_id", "bucket_no"], F.lit(0)).withColumnRenamed("bucket_no", "bucket")


#: Seconds of silence and in all that end a collection, and what a stream may be late.
QUIET, TOTAL, LATE_S = 28800, 86400, 600

_CLOSING = f"""WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS tm, event_id AS id, value > 60 AS hit FROM events
  WHERE epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - {LATE_S} * 1000) * 1000 FROM events)),
s AS (SELECT u, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS tm, CAST(0 AS BIGINT) AS number, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS n,
    CAST(NULL AS STRUCT(number BIGINT, began BIGINT, closed BIGINT, reason VARCHAR, n BIGINT, hit BIGINT)) AS gone, CAST(NULL AS STRUCT(number BIGINT, began BIGINT, closed BIGINT, reason VARCHAR, n BIGINT, hit BIGINT)) AS ended FROM (SELECT DISTINCT u FROM e)
  UNION ALL SELECT u, k, tm, number + CAST(hit AS BIGINT), CASE WHEN NOT hit THEN began END, CASE WHEN NOT hit THEN tm END, CASE WHEN hit THEN 0 ELSE n END, gone,
    CASE WHEN hit THEN {{'number': number, 'began': began, 'closed': tm, 'reason': 'target', 'n': n, 'hit': id}} END
  FROM (SELECT u, k, tm, id, hit, number + CAST(over AS BIGINT) AS number, CASE WHEN over OR began IS NULL THEN tm ELSE began END AS began, CASE WHEN over THEN 1 ELSE n + 1 END AS n,
      CASE WHEN over THEN {{'number': number, 'began': began, 'closed': due, 'reason': CASE WHEN last + {QUIET}000000 <= due THEN 'quiet' ELSE 'total' END, 'n': n, 'hit': NULL}} END AS gone
    FROM (SELECT s.*, e.k AS k2, coalesce(least(s.began + {TOTAL}000000, s.last + {QUIET}000000) <= e.tm, false) AS over, least(s.began + {TOTAL}000000, s.last + {QUIET}000000) AS due, e.tm AS tm2, e.id, e.hit
      FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1) x(u, k0, tm0, number, began, last, n, gone0, ended0, k, over, due, tm, id, hit))),
z AS (SELECT u, number, began, least(began + {TOTAL}000000, last + {QUIET}000000) AS due, last, n FROM s WHERE began IS NOT NULL AND k = (SELECT max(k) FROM e WHERE e.u = s.u)),
o AS (SELECT u, gone AS x FROM s WHERE gone IS NOT NULL UNION ALL SELECT u, ended FROM s WHERE ended IS NOT NULL
  UNION ALL SELECT u, {{'number': number, 'began': began, 'closed': due, 'reason': CASE WHEN last + {QUIET}000000 <= due THEN 'quiet' ELSE 'total' END, 'n': n, 'hit': NULL}} FROM z
  WHERE due <= (SELECT (max(epoch_us(ts)) // 1000 - {LATE_S} * 1000) * 1000 FROM events))
SELECT u AS user_id, x.number, x.began, x.closed, x.reason, x.n, x.hit FROM o"""


def _watermark(events) -> int:
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return 0 if last is None else (last // 1000 - LATE_S * 1000) * 1000


@query(_CLOSING)
def collections(t):
    """Collections of a user's events that have ended by the watermark: by a target, by silence or by total time (T-05, T-06)."""
    e = t("events").withColumn("target", F.col("value") > 60)
    return ordered.run(e, "user_id", "ts", ["event_id", "target"], ordered.Collector(QUIET, TOTAL), _watermark(e))


@_live("collections")
def collections_stream(spark, sf_dir):
    """The same of a stream, ended by timers."""
    e = _stream(spark, sf_dir).withColumn("target", F.col("value") > 60)
    return sinks.drain(ordered.run_stream(e, "user_id", "ts", ["event_id", "target"], ordered.Collector(QUIET, TOTAL), f"{LATE_S} seconds"), "collections")


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS tm, event_id AS id, value > 90 AS bad FROM events),
s AS (SELECT u, k, tm, id, CASE WHEN bad THEN 'opened' ELSE 'passed' END AS said, CASE WHEN bad THEN tm + 86400000000 END AS until, CASE WHEN bad THEN id END AS by, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS closer FROM e WHERE k = 1
  UNION ALL SELECT e.u, e.k, e.tm, e.id, CASE WHEN s.until > e.tm THEN 'skipped' WHEN bad THEN 'opened' ELSE 'passed' END, CASE WHEN s.until > e.tm THEN s.until WHEN bad THEN e.tm + 86400000000 END,
    CASE WHEN s.until > e.tm THEN s.by WHEN bad THEN e.id END, CASE WHEN s.until <= e.tm THEN s.until END, CASE WHEN s.until <= e.tm THEN s.by END FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1)
SELECT u AS user_id, tm AS "at", id, said FROM s UNION ALL SELECT u, closed, closer, 'closed' FROM s WHERE closed IS NOT NULL""")
def circuit_timer(t):
    """A user's events under a circuit that a timer closes a day after the failure that opened it (T-14)."""
    e = t("events").withColumn("failed", F.col("value") > 90)
    return ordered.run(e, "user_id", "ts", ["event_id", "failed"], ordered.Circuit(86400))


_BUFFER = """SELECT user_id, epoch_us(ts) AS "at", event_id AS id, row_number() OVER w AS seq, lag(event_id, 20) OVER w AS "left", least(20, row_number() OVER w) AS held FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(_BUFFER)
def buffer_of_newest(t):
    """A user's newest twenty events, numbered, with what each pushes out (T-01)."""
    return ordered.run(t("events"), "user_id", "ts", ["event_id"], keyed.Buffer(20))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS tm, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
  CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'get' END AS deed, props, CASE WHEN value > 2 THEN value * 600.0 END AS ttl FROM events),
w AS (SELECT *, max(CASE WHEN deed IN ('set', 'delete') THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wk,
  min(CASE WHEN deed IN ('set', 'delete') THEN tm END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM e),
j AS (SELECT w.*, CASE WHEN s.deed = 'set' AND s.ttl > 0 AND s.tm + CAST(floor(s.ttl * 1000000) AS BIGINT) > w.tm THEN s.props END AS live FROM w LEFT JOIN e s ON s.user_id = w.user_id AND s.k = w.wk)
SELECT user_id, tm AS "at", id, CASE deed WHEN 'set' THEN 'set' WHEN 'delete' THEN 'deleted' WHEN 'get' THEN CASE WHEN live IS NULL THEN 'miss' ELSE 'hit' END END AS said, CASE deed WHEN 'set' THEN props ELSE live END AS value FROM j WHERE deed IS NOT NULL
UNION ALL SELECT user_id, tm + CAST(floor(ttl * 1000000) AS BIGINT), id, 'expired', props FROM w WHERE deed = 'set' AND ttl > 0 AND tm + CAST(floor(ttl * 1000000) AS BIGINT) <= least(coalesce(next, 4000000000000000), (SELECT max(epoch_us(ts)) FROM events))""")
def session_cache(t):
    """A user's session that some events set for a time, and others read or delete (T-17)."""
    kind, e = F.col("event_type"), t("events")
    deed = F.when(kind.isin("signup", "purchase"), "set").when(kind == "error", "delete").when(kind == "click", "get")
    e = e.withColumns({"deed": deed, "ttl": F.when(F.col("value") > 2, F.col("value") * 600)})
    last = e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return ordered.run(e, "user_id", "ts", ["event_id", "deed", "props", "ttl"], keyed.Sessions(), last)


@query("""WITH w AS (SELECT user_id, max(event_id) AS after, arg_max(CASE WHEN value > 20 THEN event_type END, event_id) AS revision FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1),
h AS (SELECT user_id, event_id AS id, CASE WHEN value > 50 THEN event_type || '*' ELSE event_type END AS now, value > 60 AS target FROM events),
b AS (SELECT w.user_id, id, target, id > after AS new, coalesce(id = after AND arg.revision IS NOT NULL AND now IS DISTINCT FROM arg.revision, false) AS edited FROM w LEFT JOIN h USING (user_id) LEFT JOIN (SELECT user_id, after AS a, CASE WHEN value > 20 THEN event_type END AS revision FROM w JOIN events e USING (user_id) WHERE e.event_id = after) arg ON arg.user_id = w.user_id)
SELECT user_id, count(*) FILTER (WHERE new OR edited) AS n, min(id) FILTER (WHERE (new OR edited) AND target) AS hit, bool_or(edited) AS reopened FROM b GROUP BY user_id""")
def late_reconcile(t):
    """Histories read again after a collection has timed out: newer messages, and the boundary's own if it was edited (T-07)."""
    e = t("events")
    known = F.when(F.col("value") > 20, F.col("event_type"))
    waits = e.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.max("event_id").alias("after"), F.max_by(F.struct(known.alias("r")), "event_id").alias("x"))
    now = F.when(F.col("value") > 50, F.concat("event_type", F.lit("*"))).otherwise(F.col("event_type"))
    history = e.select("user_id", F.col("event_id").alias("id"), now.alias("revision"), (F.col("value") > 60).alias("target"))
    return ordered.reconcile(waits.select("user_id", "after", F.col("x.r").alias("revision")), history, "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, ts, event_id, value > 90 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT u, event_id, k, CASE WHEN bad THEN ts + INTERVAL 600 SECOND END AS until, CASE WHEN bad THEN 'opened' ELSE 'passed' END AS said FROM e WHERE k = 1
  UNION ALL SELECT e.u, e.event_id, e.k, CASE WHEN e.ts < s.until THEN s.until WHEN bad THEN e.ts + INTERVAL 600 SECOND END, CASE WHEN e.ts < s.until THEN 'skipped' WHEN bad THEN 'opened' ELSE 'passed' END
  FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1) SELECT event_id, said FROM s""")
def circuit_breaker(t):
    """Events of a user passed, opening the circuit, or skipped while it is open."""
    return folds.fold(t("events"), "user_id", "ts", "value", folds.breaker(600, lambda x: x > 90), "event_id").select("event_id", "said")


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) AS tm, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT u, event_id, k, tm AS last, tm AS began, 1 AS held, CAST(0 AS BIGINT) AS number FROM e WHERE k = 1
  UNION ALL SELECT u, event_id, k, tm, CASE WHEN fresh THEN tm ELSE began END, CASE WHEN fresh THEN 1 ELSE held + 1 END, number + CAST(fresh AS BIGINT)
  FROM (SELECT e.u, e.event_id, e.k, e.tm, s.began, s.held, s.number, s.held = 5 OR e.tm - s.last >= 7200000000 OR e.tm - s.began >= 86400000000 AS fresh FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1))
SELECT event_id, CAST(number AS VARCHAR) AS said FROM s""")
def collect_until(t):
    """Collections of a user's events: closed by silence, by total time, or at five events."""
    return folds.fold(t("events"), "user_id", "ts", "value", folds.collector(7200, 86400, lambda held: len(held) == 5), "event_id").select("event_id", "said")


@query("""SELECT event_id, user_id FROM events WHERE event_id > 500 OR ts > TIMESTAMP '2024-01-15 00:00:00'""")
def lower_boundary(t):
    """Events past a known id or a known time."""
    return t("events").filter((F.col("event_id") > 500) | (F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))).select("event_id", "user_id")
