"""Periods since the epoch: by no session's zone, on both sides of the epoch."""

import datetime

import duckdb
import pytest

from skeinwork.plans import registry, textual


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tehran"])
def test_buckets_in_any_zone(spark, tmp_path, zone):
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT * FROM (VALUES ('a', TIMESTAMP '1969-12-31 23:50:00.0005'), ('a', NULL), ('a', TIMESTAMP '1960-01-01 01:02:03.456789'), ('a', TIMESTAMP '1969-12-31 22:00:00'),
      ('b', TIMESTAMP '2024-03-10 02:30:00'), ('b', TIMESTAMP '2024-01-31 23:59:59.999999'), (NULL, TIMESTAMP '2024-11-03 01:30:00'), ('b', TIMESTAMP '2024-02-01 00:00:00')) t(event_type, ts)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = {(a, b, c, n) for a, b, c, n in con.execute(registry.ORACLE_SQL["epoch_bucket"]).fetchall()}
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {(r.event_type, r.period, r.bucket, r.n) for r in registry.QUERIES["epoch_bucket"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want


def test_instants_keep_their_own_zone(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 1, tzinfo=datetime.timezone.utc)
    made = spark.createDataFrame([("a", at)], "event_type string, ts timestamp")
    assert {(r.period, r.bucket) for r in textual.epoch_bucket(lambda _: made).collect()} == {(p, int(at.timestamp()) // p) for p in (1200, 7200, 86400)}
