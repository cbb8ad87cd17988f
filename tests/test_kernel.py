"""Text kernel, write semantics and queue on small cases."""

import gzip

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import policy, text
from skeinwork.operators import merge, tasks


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, wanted",
    [("بهرام ۲۴ ساعت", "بهرام 24 ساعت"), ("علي كريمي", "علی کریمی"), ("آلبوم‌های شایع", "آلبوم های شایع"), ("  A  b!", "a b"), ("", ""), ("🎵", "")],
)
def test_norm(spark, given, wanted):
    assert one(spark, text.norm(F.col("s")), s=given) == wanted


def test_identity_norm_decomposes(spark):
    assert one(spark, text.identity_norm(F.col("s")), s="Beyoncé ﬁn") == "beyonce fin"


def test_popularity_does_not_change_the_variant(spark):
    a, b = (one(spark, text.track_variant(F.col("s")), s=s) for s in ("#12 🎵 Shadmehr, Taghdir x 1.6M", "Shadmehr, Taghdir"))
    assert a == b == "shadmehr taghdir"


def test_delivery(spark):
    allowed, reason = policy.delivery(F.col("p"), F.col("r"))
    got = [tuple(x) for x in spark.createDataFrame([("iran_only", "ir"), ("iran_only", None), ("blocked_copyright", "IR"), ("global", "")], "p string, r string").select(allowed, reason).collect()]
    assert got == [(True, "iran_verified"), (False, "iran_only"), (False, "copyright"), (True, "not_region_restricted")]


def test_upsert_twice_is_upsert_once(spark):
    e = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k long, s string, n long")
    i = spark.createDataFrame([(2, "b", None), (3, None, 3)], "k long, s string, n long")
    rules = {"s": merge.old_else_new, "n": merge.new_else_old}
    once = merge.upsert(e, i, ["k"], rules)
    twice = merge.upsert(once, i, ["k"], rules)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "b", 2), (3, None, 3)]


def test_failed_tasks(spark):
    status, left = tasks.failed(F.lit("running"), F.col("n"), F.col("limited"), 3)
    got = [tuple(x) for x in spark.createDataFrame([(1, False), (3, False), (3, True)], "n long, limited boolean").select(status, left).collect()]
    assert got == [("retry", 1), ("failed", 3), ("retry", 2)]


def test_ndjson_round_trip(spark, tmp_path):
    from skeinwork.sources import ndjson

    path = tmp_path / "rows.jsonl.gz"
    path.write_bytes(gzip.compress(b'{"a": 1, "b": "x"}\r\n{"a": 2, "b": null}\n'))
    assert sorted(map(tuple, ndjson.read(spark, str(path), "a long, b string").collect())) == [(1, "x"), (2, None)]
    first = ndjson.manifest(spark, str(tmp_path / "*.gz"))
    assert ndjson.changed(first, first).count() == 0
    bad = tmp_path / "bad.jsonl.gz"
    bad.write_bytes(gzip.compress(b'{"a": 1}\nnot json\n'))
    assert [(r.line, r.text) for r in ndjson.bad_lines(spark, str(bad), "a long, b string").collect()] == [(2, "not json")]


def test_chunking():
    from skeinwork.functions.chunking import chunks

    assert chunks("aaaa\nbb\ncccc", 8) == ["aaaa\nbb", "cccc"]
    assert chunks("x" * 20, 8) == ["x" * 8, "x" * 8, "x" * 4]
    assert chunks("", 8) == [] == chunks(" \n ", 8)
    assert chunks("aaaa   \n   bb  \n\n cccc ", 12) == ["aaaa", "bb  \n\n cccc"]
    assert chunks("a\n" + "b" * 12, 8) == ["a\nbbbbbb", "bbbbbb"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_decisions(spark):
    from pyspark.sql import functions as F

    from skeinwork.functions import decisions as d

    c = F.col
    rows = [("Ébi & Dariush", "Ebi", True), ("Ebi", "Ebi & Dariush", False), ("Dariush, Ebi", "Ebi & Dariush", True), ("", "Ebi", False), (None, "x", False), ("Ebi", "EBI", True)]
    made = spark.createDataFrame(rows, "credit string, artist string, want boolean").select("want", d.credit_in_context(c("credit"), c("artist")).alias("got")).collect()
    assert all(r.got == r.want for r in made), made
    rows = [("Song (feat. Ali)", "Ali", True), ("Song ft. Ali - live", "Ali", True), ("Song", "Ali", False), (None, "Ali", False), ("Song (feat. Alibaba)", "Ali", False)]
    made = spark.createDataFrame(rows, "title string, artist string, want boolean").select("want", d.title_credits(c("title"), c("artist")).alias("got")).collect()
    assert all(r.got == r.want for r in made), made
    rows = [(0, 9, False, 0, False), (1, 0, False, 0, True), (1, 0, True, 0, False), (1, 1, False, 3, False), (2, 1, False, 0, True), (2, 2, False, 0, False), (2, 2, False, 1, True)]
    made = spark.createDataFrame(rows, "n int, best int, consensus boolean, extra int, want boolean").select("want", d.needs_fallback(c("n"), c("best"), c("consensus"), c("extra")).alias("got")).collect()
    assert all(r.got == r.want for r in made), made
    rows = [(200, "image/png", 5), (None, None, None), (204, "", 10**9), (500, "x", 1)]
    made = [tuple(r.m) for r in spark.createDataFrame(rows, "s int, t string, n long").select(d.http_meta(c("s"), c("t"), c("n")).alias("m")).collect()]
    assert made == [(True, None, "image/png", True), (False, "HTTP unknown", None, None), (False, "file too large: 1000000000", None, None), (False, "HTTP 500", None, None)]


def test_cases_of_names_and_titles(spark):
    """Cases in both scripts that no table holds."""
    cases = [
        (text.norm, "بهرام ۲۴ ساعت", "بهرام 24 ساعت"), (text.norm, "علي كريمي", "علی کریمی"), (text.norm, "آلبوم‌های  شایع", "آلبوم های شایع"), (text.norm, "25 Band - Delam!", "25 band delam"), (text.norm, "مُحَمَّد", "محمد"),
        (text.popularity, "🎵 Shadmehr, Taghdir x 1.6M", 1600000), (text.popularity, "Moein, Kabeh x 250k", 250000), (text.popularity, "A, B x <250", None), (text.popularity, "A, B x 654.…", None), (text.popularity_text, "A, B x 654.…", "654…"),
        (text.popularity, "Song without", None), (text.credit_parts, "Shayea, Ma x T-Dey", ["shayea", "ma", "t dey"]), (text.credit_parts, "Daft Punk", ["da", "punk"]), (text.credit_parts, "", []),
        (text.title_core, "آهنگ ریمیکس", "آهنگ"), (text.variant_kinds, "Delam live acoustic", ["acoustic", "live"]), (text.featured_credits, "Love (feat. Reza & Ali)", ["Reza & Ali"]), (text.script_family, "abc علی", "mixed"),
    ]
    pairs = [
        (text.cross_script_same, "رضا بهرام", "Reza Bahram", True), (text.cross_script_same, "یاس", "Ali Sorena", False), (text.cross_script_same, "محمدرضا", "Mohammad Reza", True), (text.cross_script_same, "Reza", "Reza", False),
        (text.credits_compatible, "25 Band", "25Band", True), (text.credits_compatible, "Drake & Yeat", "Yeat, Drake", True), (text.credits_compatible, "Ali Sorena", "Ali Sorena Tribute", False), (text.credits_compatible, "Drake", "Drake & Yeat", False),
        (text.titles_compatible, "Love", "Love Story", False), (text.titles_compatible, "مریم", "Maryam", True), (text.titles_compatible, "Party", "Party Remix", False), (text.titles_compatible, "Song (feat. A)", "song", True),
    ]
    made = [f(F.lit(a)).alias(f"c{i}") for i, (f, a, _) in enumerate(cases)] + [f(F.lit(a), F.lit(b)).alias(f"p{i}") for i, (f, a, b, _) in enumerate(pairs)]
    got, want = list(spark.range(1).select(*made).first()), [c[-1] for c in cases + pairs]
    assert [(c, g) for c, g, w in zip(cases + pairs, got, want) if g != w] == []
