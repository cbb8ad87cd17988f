"""Machines with deadlines: by hand, and streams of shuffled micro-batches against the batch; sinks that can be replayed."""

import datetime
import random

from pyspark.sql import functions as F

from skeinwork.streaming import ordered, sinks

S = 1_000_000


def told(machine, events, upto=None):
    return ordered.advance(machine, None, [(int(at * S), row) for at, row in events], None if upto is None else int(upto * S))[1]


def test_collector_by_hand():
    quiet = ordered.Collector(2, 5)
    assert told(quiet, [(0, (1, False)), (1, (2, False)), (3, (3, False))]) == [(0, 0, 3 * S, "quiet", 2, None)]
    assert told(quiet, [(0, (1, False)), (1, (1, False))], 9) == [(0, 0, 3 * S, "quiet", 1, None)]
    assert told(quiet, [(t, (t, False)) for t in range(7)], 6) == [(0, 0, 5 * S, "total", 5, None)]
    assert told(quiet, [(0, (1, False)), (1, (2, True)), (1, (3, False))], 3) == [(0, 0, 1 * S, "target", 2, 2), (1, 1 * S, 3 * S, "quiet", 1, None)]
    assert told(ordered.Collector(None, 5), [(0, (1, False)), (4, (2, True))], 9) == [(0, 0, 4 * S, "target", 2, 2)]
    assert told(ordered.Collector(None, 5), [(0, (1, False)), (4, (2, False))], 9) == [(0, 0, 5 * S, "total", 2, None)]
    assert told(ordered.Collector(2, 5, after=10), [(0, (10, True)), (1, (11, True))], 9) == [(0, 1 * S, 1 * S, "target", 1, 11)]
    assert told(quiet, [], 9) == []


def test_circuit_by_hand():
    got = told(ordered.Circuit(10), [(0, (1, False)), (1, (2, True)), (5, (3, True)), (11, (4, False)), (12, (5, True))], 30)
    assert got == [(0, 1, "passed"), (1 * S, 2, "opened"), (5 * S, 3, "skipped"), (11 * S, 2, "closed"), (11 * S, 4, "passed"), (12 * S, 5, "opened"), (22 * S, 5, "closed")]


def _shuffled(spark, path, rows, parts):
    """Files of rows that come out of order by 60 seconds at most, one micro-batch each."""
    rng = random.Random(3)
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.randint(0, 59)))
    step = -(-len(order) // parts)
    for k in range(parts):
        spark.createDataFrame(order[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


SCHEMA = "id long, k string, ts timestamp, bad boolean"


def test_shuffled_micro_batches_give_the_batch(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice("aab"), start + datetime.timedelta(seconds=rng.randint(0, 4000)), rng.random() < 0.1) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    last = table.agg(F.max(F.unix_micros("ts"))).first()[0]
    for name, machine in (("collect", ordered.Collector(40, 200)), ("circuit", ordered.Circuit(120))):
        stream = _shuffled(spark, str(tmp_path / name), rows, 4)
        live = sinks.drain(ordered.run_stream(stream, "k", "ts", ["id", "bad"], machine, "60 seconds"), name)
        batch = ordered.run(table, "k", "ts", ["id", "bad"], machine, (last // 1000 - 60_000) * 1000)
        want = sorted(map(tuple, batch.collect()), key=repr)
        assert sorted(map(tuple, live.collect()), key=repr) == want and len(want) > 20


def test_runs_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, datetime.datetime(2024, 1, 1), True), (2, "a", None, True), (3, "a", datetime.datetime(2024, 1, 1), True)], SCHEMA)
    got = ordered.run(rows, "k", "ts", ["id", "bad"], ordered.Circuit(1), None).collect()
    assert sorted((r.k or "", r.id, r.said) for r in got) == [("", 1, "opened"), ("a", 3, "opened")]
    assert ordered.run(rows.limit(0), "k", "ts", ["id", "bad"], ordered.Collector(1, 1), 5).count() == 0


def test_reconcile(spark):
    waits = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x"), ("c", 5, None), ("d", 5, "x")], "k string, after long, revision string")
    history = spark.createDataFrame([("a", 5, "x", True), ("a", 4, "n", True), ("b", 5, "y", True), ("b", 6, "n", True), ("c", 5, "y", True), ("c", 7, "n", False), ("e", 1, "n", True)], "k string, id long, revision string, target boolean")
    got = {r.k: (r.n, r.hit, r.reopened) for r in ordered.reconcile(waits, history, "k").collect()}
    assert got == {"a": (0, None, False), "b": (2, 5, True), "c": (1, None, False), "d": (0, None, False)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    write = sinks.upserting(path, ["k"], F.col("seq"), buckets=4)
    one = spark.createDataFrame([(i, 1, f"one {i}") for i in range(20)] + [(None, 1, "none")], "k int, seq int, v string")
    two = spark.createDataFrame([(3, 2, "two"), (4, 0, "late"), (30, 2, "new"), (3, 2, "tie")], "k int, seq int, v string")
    write(one, 0)
    before = sorted(map(tuple, sinks.newest(spark, path).drop("bucket").collect()), key=repr)
    write(one, 0)
    assert sorted(map(tuple, sinks.newest(spark, path).drop("bucket").collect()), key=repr) == before and len(before) == 21
    write(two, 1)
    after = {r.k: (r.seq, r.v) for r in sinks.newest(spark, path).collect()}
    assert after[3] == (2, "two") and after[4] == (1, "one 4") and after[30] == (2, "new") and len(after) == 22
    for again in range(2):
        write(two, 1)
        assert {r.k: (r.seq, r.v) for r in sinks.newest(spark, path).collect()} == after
    write(two.limit(0), 2)
    assert sinks.vacuum(spark, path, 9) > 0 and sinks.vacuum(spark, path, 9) == 0
    assert {r.k: (r.seq, r.v) for r in sinks.newest(spark, path).collect()} == after
    assert sinks.newest(spark, str(tmp_path / "nothing")) is None
