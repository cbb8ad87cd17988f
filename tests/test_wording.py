"""Albums, exact names, lyrics, spellings and lenient identity, each in one table of cases."""

from pyspark.sql import functions as F

from skeinwork.functions import wording as w

C = F.col


def check(spark, schema, cases, made):
    """``cases``: rows and what ``made`` must be of each."""
    rows = [(k, *row) for k, (row, _) in enumerate(cases)]
    got = {r.k: r.x for r in spark.createDataFrame(rows, f"k int, {schema}").select("k", made.alias("x")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_album_queries(spark):
    cases = [(("آلبوم های علی",), ["علی"]), (("های علی",), ["های", "علی"]), (("Albums by  Ali",), ["by", "ali"]), (("",), []), ((None,), None)]
    check(spark, "q string", cases, w.album_words(C("q")))
    cases = [
        (("album ali", "Ali", "Delam"), True), (("ali", "Ali", "Delam"), False), (("ali delam", "Ali", "Delam (Deluxe)"), True), (("ali dela", "Ali", "Delam"), True),
        (("ali other", "Ali", "Delam"), False), (("ali delam", None, "Ali Delam"), True), (("x", "Ali", None), False), (("", "", ""), False),
    ]
    check(spark, "q string, a string, t string", cases, w.album_answers(C("q"), C("a"), C("t")))
    cases = [
        (("album delam", "Ali", ["Other", "Delam"]), True), (("album ali", "Ali", ["Delam"]), False), (("ali x", "Ali", []), True), (("reza x", "Ali", None), False),
        (("x", None, ["", None]), False), ((None, "Ali", ["Delam"]), False),
    ]
    check(spark, "q string, a string, t array<string>", cases, w.names_album(C("q"), C("a"), C("t")))


def test_track_names(spark):
    cases = [(("Ali", "Love!"), ["ali love", "love ali"]), (("A", "a"), ["a a"]), ((None, "Love"), ["love"]), ((" ", None), [])]
    check(spark, "a string, t string", cases, w.track_names(C("a"), C("t")))


def test_lyrics(spark):
    raw = "Ali\n\n one \r\n#tag\nLOVE\nsee @shop\nmy shop.\nshopping\nدانلود  آهنگ جدید\n♫♫\n two"
    cases = [((raw, "ali", "Love"), "one\nshopping\ntwo"), ((raw, None, None), "Ali\none\nLOVE\nshopping\ntwo"), (("", "a", "b"), ""), ((None, "a", "b"), None)]
    check(spark, "s string, a string, t string", cases, w.lyrics(C("s"), C("a"), C("t"), "shop"))


def test_spellings(spark):
    cases = [
        (("love", "Ali", "Love"), ["love", "Love Ali", "Love"]),
        ((None, "Ali", "Love (feat. Reza)"), ["Love (feat. Reza) Ali", "Ali Love", "Love Ali", "Love", "Love (feat. Reza)"]),
        (("q", "Ali Vs. Reza", "Love"), ["q", "Love Ali Vs. Reza", "Ali vs Reza Love", "Love"]),
        (("", None, None), []), ((" x  y ", "", "x y"), ["x y"]),
    ]
    check(spark, "q string, a string, t string", cases, w.spellings(C("q"), C("a"), C("t")))


def test_lenient_identity(spark):
    cases = [
        (("Ali", "ALI"), True), (("Ali Sorena", "AliSorena"), True), (("Ali", "Reza & Ali"), True), (("Ali & Reza", "Ali"), False), (("Ali & Reza", "Reza, Ali, Z"), True),
        (("Farhad", "Farhad Ravanbakhsh"), False), (("Reza Bahram", "The Reza Bahram"), True), (("Ali", None), False), (("", ""), False), (("&", "&"), False),
    ]
    check(spark, "a string, b string", cases, w.leniently_same_artist(C("a"), C("b")))
    cases = [(("Ali", "Love", "Reza & Ali", "Love (feat. X)"), True), (("Ali", "Love", None, "love"), True), (("Ali", "Love", "Reza", "Love"), False), ((None, None, None, None), False), (("A", "", "A", ""), False)]
    check(spark, "a string, t string, b string, u string", cases, w.leniently_same_track(*map(C, "atbu")))


def test_repaired(spark):
    cases = [
        (("X", "Page", True, "Ali  B", "File"), ("Ali B", "Page", False)), (("X", "Page", False, "Ali", "File"), ("Ali", "File", False)), (("X", "Page", None, "Ali", " "), ("Ali", "Page", False)),
        (("X", None, True, "Ali", "File"), ("Ali", "File", False)), (("X", "Page", True, " ", "File"), ("X", "Page", True)), (("X", "", True, "Ali", None), ("X", "", True)),
    ]
    check(spark, "a string, t string, i boolean, p string, n string", cases, w.repaired(*map(C, "atipn")))
