"""Keyed folds: step by step, and batch against stream."""

from compare import SF

from skeinwork.streaming import folds, sinks


def said(step, events):
    state, out = None, []
    for at, value in events:
        state, x = step(state, at, value)
        out.append(x)
    return out


def test_steps():
    assert said(folds.cooldown(10), [(0, 0), (5, 0), (11, 0), (20, 0)]) == ["accepted", "limited", "accepted", "limited"]
    assert said(folds.debounce(15), [(0, 0), (5, 0), (15, 0)]) == ["active", None, "active"]
    assert said(folds.breaker(600, lambda x: x < 0), [(0, 1), (1, -1), (2, 1), (601, 1)]) == ["passed", "opened", "skipped", "passed"]
    assert said(folds.pacing(), [(0, True), (1, True), (2, True), (3, False)]) == ["2625", "4594", "5000", "5000"]
    assert said(folds.pacing(), [(i, False) for i in range(500)])[-1] == "1450"
    assert said(folds.collector(1, 5), [(0, 0), (0.5, 0), (2, 0), (2.9, 0), (3.8, 0), (4.7, 0), (5.6, 0), (6.5, 0), (7.1, 0)]) == ["0", "0", "1", "1", "1", "1", "1", "1", "2"]
    assert said(folds.collector(9, 99, lambda held: len(held) == 2), [(0, 0), (1, 0), (2, 0), (3, 0)]) == ["0", "0", "1", "1"]
    assert said(folds.coalesce(3), [(0, 0), (2, 0), (3, 0)]) == ["queued", "dropped", "queued"]


def test_batch_and_stream_agree(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    args = ("user_id", "ts", "value", folds.breaker(86400, lambda x: x > 90), "event_id")
    batch = {r.event_id: r.said for r in folds.fold(spark.read.parquet(f"{SF}/events.parquet"), *args).collect()}
    live = {r.event_id: r.said for r in sinks.drain(folds.fold_stream(stream, *args), "folds_live").collect()}
    held_back = set(batch) - set(live)  # what is later than the watermark still waits
    assert len(held_back) <= 1 and live == {k: v for k, v in batch.items() if k not in held_back}
    assert {"opened", "skipped", "passed"} <= set(batch.values())
