"""Alias chains against following them one by one."""

import random

from pyspark.sql import functions as F

from skeinwork.operators import aliases


def _follow(rows):
    newest = {}
    for alias, target, at in rows:
        if alias is None or target is None or alias == target:
            continue
        if alias not in newest or at > newest[alias][0]:
            newest[alias] = (at, {target})
        elif at == newest[alias][0]:
            newest[alias][1].add(target)
    out = {}
    for alias, (_, targets) in newest.items():
        if len(targets) > 1:
            out[alias] = (alias, "conflict")
            continue
        way, at = {alias}, next(iter(targets))
        while at in newest and len(newest[at][1]) == 1 and at not in way:
            way.add(at)
            at = next(iter(newest[at][1]))
        out[alias] = (alias, "cycle") if at in way else (at, "resolved")
    return out


def test_chains_cycles_and_conflicts(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", f"c{i + 1}", 1) for i in range(50)] + [("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("w", "z", 1), ("s", "s", 1), (None, "a", 1), ("a", None, 1)]
    rows += [("d", "e", 1), ("d", "f", 1), ("g", "d", 1), ("h", "i", 1), ("h", "j", 2), ("h", "j", 2), ("one", "two", 1), ("two", "one", 1)]
    rows += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}", rng.randrange(3)) for _ in range(90)]
    df = spark.createDataFrame(rows, "alias string, target string, at int")
    got = {r.alias: (r.canonical, r.state) for r in aliases.resolve(aliases.links(df)).collect()}
    assert got == _follow(rows) and got["c0"] == ("c50", "resolved") and got["w"] == ("w", "cycle") and got["g"] == ("d", "resolved")
    assert aliases.resolve(aliases.links(df.limit(0))).count() == 0


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    real = aliases.materialize
    monkeypatch.setattr(aliases, "materialize", lambda df, label: rounds.append(label) or real(df, label))
    df = spark.createDataFrame([(i, i + 1, 1) for i in range(100)], "alias long, target long, at int")
    assert {r.canonical for r in aliases.resolve(aliases.links(df)).collect()} == {100}
    assert rounds.count("jump") <= 9


def test_learning(spark):
    tracks = spark.createDataFrame([("25 Band", "Delam"), ("Ali", "Yar"), ("", "x"), (None, None)], "artist string, title string")
    rows = [("25 band|delam|v1", "Other", "Delam", 9), ("25 band|delam|v2", "25Band", "Delam", 8), ("25 band|delam|v3", "25 Band", "Delam", 7), ("ali|yar|1", "Ali", "Yar Remix", 3), ("ali|yar|2", "Ali", "Yar", 2), ("ali|yar", None, "Yar", 1)]
    cached = spark.createDataFrame(rows, "track_key string, performer string, title string, at int")
    assert [tuple(r) for r in aliases.learn(tracks, cached).collect()] == [("25 band|delam", "25band|delam")]
    fits = aliases.compatible(F.lit("A & B"), F.lit("X"), F.lit("B, A"), F.lit("x"))
    assert spark.range(1).select(fits.alias("x")).first().x
