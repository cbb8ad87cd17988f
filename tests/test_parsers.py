"""Parsers and verification on the domain's cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import parsers


@pytest.mark.parametrize(
    "row, fallback, want",
    [
        ("🎵 Shadmehr, Taghdir x 1.6M", None, ("Shadmehr", "Taghdir", False, "1.6M", 1600000)),
        ("#49 🎵 A, B x <250", None, ("A", "B", False, "<250", None)),
        ("A – T", None, ("A", "T", False, None, None)),
        ("Only Title", "Who", ("Who", "Only Title", True, None, None)),
        ("Only Title", None, None), ("بعدی", "Who", None), ("صفحه بعد", None, None), ("💿 Album", "Who", None), ("", "Who", None),
    ],
)
def test_track_row(spark, row, fallback, want):
    df = spark.createDataFrame([(row, fallback)], "s string, f string")
    got = df.select(parsers.track_row(F.col("s"), F.col("f")).alias("x")).first().x
    assert (got if got is None else tuple(got)) == want


def test_album_listings(spark):
    rows = [(1, "آلبوم ها (۲)", "Delam (12)"), (1, "آلبوم ها (۲)", "💿 Other"), (1, "آلبوم ها (۲)", "Third (3)"), (2, "(۲)", "A (1)"), (2, "(۲)", "B (2)"), (3, "(۰)", ""), (4, "songs", "Live (2004)")]
    got = {r.l: (r.declared, r.albums, r.complete, r.confirmed_empty) for r in parsers.album_listings(spark.createDataFrame(rows, "l long, h string, r string"), "l", "h", "r").collect()}
    assert got == {1: (2, 3, False, False), 2: (2, 2, True, False), 3: (0, 0, True, True), 4: (None, 0, False, False)}


def test_audio_heads(spark):
    heads = {b"ID3\x04": True, b"\xff\xfb\x90": True, b"OggS..": True, b"RIFF....WAVE": True, b"RIFF....AVI ": False, b"\x00\x00\x00\x20ftypM4A ": True, b"<html>": False, b"\xff": False, b"": False}
    got = {bytes(r.b): r.x for r in spark.createDataFrame([(bytearray(b),) for b in heads], "b binary").select("b", parsers.is_audio(F.col("b")).alias("x")).collect()}
    assert got == heads


@pytest.mark.parametrize(
    "given, got, ok, reason",
    [
        (("A", "Song", 200), ("f", None, None, 202), True, None),
        (("A", "Song", 200), ("f", None, None, 205), False, "insufficient evidence"),
        (("A", "Song", 200), ("f", "A", "Song", 220), False, "duration mismatch"),
        (("A", "Song", 200), ("f", "A", "Song Remix", 200), False, "title contradicts"),
        (("رضا بهرام", "Song", None), ("f", "Reza Bahram", None, None), True, None),
        (("A", "Song", 200), (None, "A", "Song", 200), False, "no file"),
    ],
)
def test_verify_audio(spark, given, got, ok, reason):
    df = spark.createDataFrame([(*given, *got)], "a string, t string, s int, f string, ga string, gt string, gs int")
    c = F.col
    made = df.select(parsers.verify_audio(c("a"), c("t"), c("s"), c("f").isNotNull(), c("ga"), c("gt"), c("gs")).alias("x")).first().x
    assert (made.ok, made.reason) == (ok, reason)


def test_release_date(spark):
    cases = {"📅 March 5, 2021": datetime.date(2021, 3, 5), "no date\n2019-07-01": datetime.date(2019, 7, 1), "1999?": None, "": None}
    got = {r.s: r.d for r in spark.createDataFrame([(s,) for s in cases], "s string").select("s", parsers.release_date(F.col("s")).alias("d")).collect()}
    assert got == cases
