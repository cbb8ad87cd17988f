"""Buffers and sessions: by hand, and streams of shuffled micro-batches against the batch."""

import datetime
import random

from pyspark.sql import functions as F
from test_ordered import S, told

from skeinwork.streaming import keyed, ordered, sinks

SCHEMA = "id long, k string, ts timestamp, deed string, value string, seconds double"


def test_buffer_by_hand():
    assert told(keyed.Buffer(2), [(t, (10 + t,)) for t in range(4)], 9) == [(0, 10, 1, None, 1), (S, 11, 2, None, 2), (2 * S, 12, 3, 10, 2), (3 * S, 13, 4, 11, 2)]
    assert told(keyed.Buffer(1), [(0, (7,)), (0, (7,))]) == [(0, 7, 1, None, 1), (0, 7, 2, 7, 1)]


def test_sessions_by_hand():
    events = [(0, (1, "get", None, None)), (1, (2, "set", "a", 5.0)), (5, (3, "get", None, None)), (6, (4, "get", None, None)), (7, (5, "set", "b", 5.0)), (8, (6, "set", None, 2.0)), (9, (7, "get", None, None))]
    assert told(keyed.Sessions(), events, 20) == [
        (0, 1, "miss", None), (S, 2, "set", "a"), (5 * S, 3, "hit", "a"), (6 * S, 2, "expired", "a"), (6 * S, 4, "miss", None),
        (7 * S, 5, "set", "b"), (8 * S, 6, "set", None), (9 * S, 7, "hit", None), (10 * S, 6, "expired", None),
    ]
    events = [(0, (1, "set", "a", 5.0)), (1, (2, "other", "x", 1.0)), (2, (3, "delete", None, None)), (3, (4, "get", None, None)), (4, (5, "set", "b", None)), (5, (6, "set", "c", 0.0)), (6, (7, None, None, None))]
    assert told(keyed.Sessions(), events, 20) == [(0, 1, "set", "a"), (2 * S, 3, "deleted", "a"), (3 * S, 4, "miss", None), (4 * S, 5, "set", "b"), (5 * S, 6, "set", "c")]


def test_streams_give_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice("aab"), start + datetime.timedelta(seconds=rng.randint(0, 4000)), rng.choice(["set", "get", "get", "delete", None]), f"v{i}", float(rng.randint(0, 90))) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    upto = (table.agg(F.max(F.unix_micros("ts"))).first()[0] // 1000 - 60_000) * 1000
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.randint(0, 59)))
    for k in range(0, 300, 75):
        spark.createDataFrame(order[k : k + 75], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, machine, columns in (("buffer", keyed.Buffer(7), ["id"]), ("sessions", keyed.Sessions(), ["id", "deed", "value", "seconds"])):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live = sinks.drain(ordered.run_stream(stream, "k", "ts", columns, machine, "60 seconds"), name)
        want = sorted(map(tuple, ordered.run(table, "k", "ts", columns, machine, upto).collect()), key=repr)
        assert sorted(map(tuple, live.collect()), key=repr) == want and len(want) > 200
