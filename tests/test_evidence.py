"""Evidence: every pattern of agreeing, contradicting and silent checks, scores, fresh answers, retries and captions."""

import itertools

from pyspark.sql import functions as F

from skeinwork.functions import evidence as e

C = F.col


def test_every_pattern(spark):
    rows = list(itertools.product((True, False, None), repeat=3))
    df = spark.createDataFrame(rows, "title boolean, artist boolean, duration boolean").select("*", F.struct("title", "artist", "duration").alias("c"))
    for r in df.select("c.*", e.contradictions(C("c")).alias("against"), e.confirmed(C("c")).alias("sure"), e.plausible(C("c")).alias("may")).collect():
        checks = {"title": r.title, "artist": r.artist, "duration": r.duration}
        assert r.against == [k for k, v in checks.items() if v is False]
        assert r.sure == (not r.against and (r.title is True or r.artist is True))
        assert r.may == (r.duration is not False and [r.title, r.artist].count(False) < 2)


TAGS = [
    (("Ali", "Love", False, 200), ("Ali", "Love", 205), True, (True, True, True), (True, True, True)),
    (("Ali", "Love", False, 200), (None, " ", None), True, (None, None, None), (None, None, None)),
    (("Ali", "Love", True, 200), (None, "Love", 0), False, (True, None, None), (True, None, None)),
    (("Ali", "Love", False, 200), ("Reza", "Love (feat. Ali)", 300), True, (True, False, False), (True, False, False)),
    (("Ali", "Love", False, 200), ("Ali & Reza", "Love Remix", 200), False, (False, False, True), (False, True, True)),
    (("Ali", "Love", False, None), (None, "Ali – Love", 200), False, (False, None, None), (True, True, None)),
    (("رضا بهرام", "Love", False, 1), ("Reza Bahram", "Love", 1), True, (True, False, True), (True, False, True)),
    ((None, None, None, None), ("Ali", "Love", 1), True, (False, False, None), (False, False, None)),
]


def test_file_tags(spark):
    df = spark.createDataFrame([(k, *track, *tags) for k, (track, tags, *_) in enumerate(TAGS)], "k int, a string, t string, i boolean, s int, ga string, gt string, gs int")
    given = [C(x) for x in ("a", "t", "s", "ga", "gt", "gs")]
    made = df.select("k", e.file_matches(C("a"), C("t"), C("i"), C("ga"), C("gt")).alias("m"), e.checks(*given).alias("c"), e.loose_checks(*given).alias("l"))
    assert {r.k: (r.m, tuple(r.c), tuple(r.l)) for r in made.collect()} == {k: tuple(want) for k, (_, _, *want) in enumerate(TAGS)}


CANDIDATES = [
    (["Reza", "Ali"], "Love", 203.5, (True, 219.5, True, True, True, 3.5)),
    (["Ali"], "Love", 230.0, (False, 200.0, True, True, False, 30.0)),
    (["Ali"], "Love", None, (True, 200.0, True, True, True, None)),
    ([None, ""], None, 200.0, (False, 30.0, False, False, True, 0.0)),
    (None, "Love", 0.0, (False, 100.0, True, False, True, None)),
]


def test_candidate_score(spark):
    df = spark.createDataFrame([(k, "Ali", "Love", 200, *x[:3]) for k, x in enumerate(CANDIDATES)], "k int, a string, t string, s int, l array<string>, n string, g double")
    df = df.withColumns({"x": e.same_title(C("t"), C("n")), "y": e.any_artist(C("a"), C("l"))})
    made = df.select("k", e.candidate_score(*(C(x) for x in "xysg")).alias("m"))
    assert {r.k: tuple(r.m) for r in made.collect()} == {k: x[3] for k, x in enumerate(CANDIDATES)}


ANSWERS = [
    (("7", "ALI", "Love"), ("https://h.example/mp3-320/a", "https://h.example/mp3-320/a", "http://x.example/b"), None, [("https://h.example/mp3-320/a", "h.example", 320, "high")]),
    ((None, "Ali", "love"), (None, "https://H.example/a?b=c", "https://h.example/l"), None, [("https://H.example/a?b=c", "h.example", None, "plain"), ("https://h.example/l", "h.example", 128, "low")]),
    (("8", "Ali", "Love"), ("https://h.example/a", None, None), "id 8 instead of 7", None),
    (("7", "Reza", "Love"), ("https://h.example/a", None, None), "artist differs", None),
    (("7", "Ali", "Love Remix"), ("https://h.example/a", None, None), "title differs", None),
    (("7", None, None), ("https://h.example/a", None, None), "artist and title differ", None),
    (("7", "Ali", "Love"), ("not a url", "", "ftp://h.example/a"), "no link", None),
    ((None, " ", None), (None, None, None), "empty", None),
]


def test_recovered(spark):
    df = spark.createDataFrame([(k, "7", "Ali", "Love", *got, *urls) for k, (got, urls, *_) in enumerate(ANSWERS)], "k int, i string, a string, t string, gi string, ga string, gt string, u string, v string, w string")
    found = e.links((C("u"), 256, "high"), (C("v"), None, "plain"), (C("w"), 128, "low"))
    df = df.withColumn("l", found).withColumns({"x": e.same_artist(C("a"), C("ga")), "y": e.same_title(C("t"), C("gt")), "z": e.says_nothing(C("l"), C("gi"), C("ga"), C("gt"))})
    made = {r.k: r.m for r in df.select("k", e.recovered(C("i"), C("gi"), C("x"), C("y"), C("z"), F.lit(0), C("l")).alias("m")).collect()}
    for k, (_, _, reason, links) in enumerate(ANSWERS):
        assert (made[k].ok, made[k].reason, made[k].seconds, made[k].id) == (reason is None, reason, None, "7" if reason is None else None)
        assert (made[k].candidates and [tuple(x) for x in made[k].candidates]) == links


def test_retryable(spark):
    passing = "unexpected content-type text/plain"
    cases = [(None, True), ((1, False, f"x: {passing}"), True), ((None, False, passing), True), ((2, False, passing), False), ((1, True, passing), False), ((1, None, passing), False), ((1, False, "HTTP 500"), False), ((1, False, None), False)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, a struct<version: int, ok: boolean, reason: string>")
    got = {r.i: r.x for r in df.select("i", e.retryable(C("a")).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_captions(spark):
    cases = {
        "up:3:abc:320:h.example": (3, "abc", 320, "h.example"), "up:abc:128:h": (1, "abc", 128, "h"), "up:abc": (1, "abc", None, ""), "up:0:abc:1:h": None, "up:2::1:h": None,
        "up:": None, "upper:1:a:1:h": None, "": None, " up:2:a::  h ": (2, "a", None, "h"), "up:77:320:h": (1, "77", 320, "h"), "up:a:b:c:d": (1, "a", None, "c"),
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", e.read_caption("up", C("s")).alias("c"))
    assert {r.s: r.c and tuple(r.c) for r in df.collect()} == cases
    rows = [(1, "a", 320, "h"), (12, "b", None, None), (2, "c", 0, "h")]
    back = spark.createDataFrame(rows, "s int, i string, q int, h string").select(e.read_caption("up", e.caption("up", C("s"), C("i"), C("q"), C("h"))).alias("c"))
    assert {tuple(r.c) for r in back.collect()} == {(1, "a", 320, "h"), (12, "b", None, ""), (2, "c", None, "h")}
