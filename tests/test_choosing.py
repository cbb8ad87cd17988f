"""Choices of an artist, an entry and a refinement: every tier, ties, nothing to choose, awkward rows."""

import random
from collections import Counter

import pytest

from skeinwork.operators import choosing


@pytest.mark.parametrize(
    "query, tracks, albums, want",
    [
        ("Ali", [("Reza", True, False), ("ALI", True, False)], [], ("ALI", "exact", 1)),
        ("Ali", [("Ali", True, True), ("Ali", False, False)], [], (None, None, None)),
        ("album Ali", [("Ali", True, False)], [("Reza", 0)], ("Reza", "album", 0)),
        ("Ali", [("Ali Sorena", True, False), ("ali sorena", True, False)], [], ("Ali Sorena", "dominant", 0)),
        ("Ali", [("Ali Sorena", True, True), ("Ali Sorena", True, False)], [], ("Ali Sorena", "dominant", 1)),
        ("Ali", [("Ali Sorena", True, False), ("Ali Sorena", True, False), ("Ali Reza", True, False)], [], (None, None, None)),
        ("love", [("Ali Sorena", True, False), ("Ali Sorena", True, False)], [("Ali Sorena", 4)], (None, None, None)),
        (None, [("Ali", True, False), ("Reza", True, False), ("Reza", True, False)], [], ("Reza", "dominant", 1)),
        (None, [("Ali", True, False)], [("Reza", 2), ("reza", 1)], ("reza", "album", 1)),
        ("", [], [("Reza", 2), ("Ali", 1)], (None, None, None)),
        ("Reza", [], [("Reza B", 2)], ("Reza B", "album", 2)),
        ("x", [], [], (None, None, None)),
    ],
)
def test_shortcuts(spark, query, tracks, albums, want):
    q = spark.createDataFrame([(1, query)], "session long, query string")
    t = spark.createDataFrame([(1, i, *x, "clash") for i, x in enumerate(tracks)], "session long, ord long, artist string, own boolean, inferred boolean, query string")
    a = spark.createDataFrame([(1, o, n) for n, o in albums], "session long, ord long, artist string")
    assert [tuple(r) for r in choosing.shortcuts(q, t, a).collect()] == [(1, *want)]


@pytest.mark.parametrize(
    "requested, items, want",
    [
        ("Ali Sorena", [("Ali", False), ("ali  sorena", False)], ("ali  sorena", 0, 1)),
        ("Ali Sorena", [("Ali Sorena Band", False), ("AliSorena", False)], ("AliSorena", 1, 1)),
        ("The Ali Sorena", [("Ali", False), ("Ali Sorena", False), ("The Ali", False)], ("Ali Sorena", 2, 1)),
        ("Farhad", [("Farhad Ravanbakhsh", False)], (None, None, None)),
        ("Ali Sorena & Reza B", [("Ali Sorena", False), ("Reza B", False)], (None, None, None)),
        ("Ali Sorena & Reza B", [("Ali Sorena", False), ("the artist", True)], ("the artist", 3, 1)),
        (None, [("Ali", False)], ("Ali", 4, 0)),
        ("", [("Ali", False), ("Reza", False)], (None, None, None)),
        ("Ali", [("", False), (None, False)], (None, None, None)),
    ],
)
def test_pickers(spark, requested, items, want):
    r = spark.createDataFrame([(1, requested)], "session long, requested string")
    i = spark.createDataFrame([(1, k, *x) for k, x in enumerate(items)], "session long, ord long, name string, generic boolean")
    assert [tuple(x) for x in choosing.pickers(r, i).collect()] == [(1, *want)]


@pytest.mark.parametrize(
    "query, buttons, want",
    [
        ("Farhad", ["🎤 Farhad Ravanbakhsh", "Farhad live", "🎤 Farhad"], ("🎤 Farhad", 100, 2)),
        ("red song", ["red song", "🎤 red song", "💿 red song", "A, red song", "بعدی"], ("red song", 128, 0)),
        ("one two", ["two three", "two four"], ("two three", 28, 0)),
        ("one", ["other", "", None], (None, None, None)),
        (None, ["one"], (None, None, None)),
    ],
)
def test_refinements(spark, query, buttons, want):
    r = spark.createDataFrame([(1, query)], "session long, query string")
    b = spark.createDataFrame([(1, k, x) for k, x in enumerate(buttons)], "session long, ord long, button string")
    assert [tuple(x) for x in choosing.refinements(r, b).collect()] == [(1, *want)]


def test_awkward_rows(spark):
    q = spark.createDataFrame([(1, "b"), (1, "ali"), (None, "ali"), (2, None)], "session long, query string")
    t = spark.createDataFrame([(1, None, "Ali", True, False), (None, 1, "Ali", True, False), (1, 3, "Ali", None, None), (1, 4, "Ali", True, None), (1, 4, "Ali", True, None)], "session long, ord long, artist string, own boolean, inferred boolean")
    got = choosing.shortcuts(q, t, t)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "Ali", "exact", 4), (2, None, None, None)]
    assert choosing.shortcuts(q.limit(0), t, t).count() == 0


def test_shortcuts_of_many_lists(spark):
    """Against a plain reading of the rules, one long list among them."""
    rng = random.Random(5)
    names = ["Ali", "Ali Sorena", "Reza", "Reza Sorena", "Sorena"]
    said = {s: rng.choice([*names, "", "Sorena", "album Reza", "nobody"]) for s in range(60)}
    tracks = [(0 if rng.random() < 0.4 else rng.randrange(60), i, rng.choice(names), rng.random() < 0.8, rng.random() < 0.3) for i in range(400)]
    albums = [(rng.randrange(60), i, rng.choice(names)) for i in range(50)]

    def choose(s):
        words = [w for w in said[s].lower().split() if w != "album"]
        fits = lambda n: not said[s] or bool(words) and set(words) <= set(n.lower().split())
        own = [t for t in sorted(tracks) if t[0] == s and t[3]]
        explicit = {n: next((t[1] for t in own if t[2] == n and not t[4]), None) for n in names}
        for n in names:
            if n.lower() == said[s].lower() and explicit[n] is not None:
                return n, "exact", explicit[n]
        ranked = sorted(Counter(t[2] for t in own).items(), key=lambda x: (-x[1], next(t[1] for t in own if t[2] == x[0])))
        if ranked and ranked[0][1] >= 2 and explicit[ranked[0][0]] is not None:
            n = ranked[0][0]
            if not said[s] or fits(n) and sum(fits(m) and explicit[m] is not None for m in names) == 1:
                return n, "dominant", explicit[n]
        mine = [a for a in albums if a[0] == s]
        if len({a[2] for a in mine}) == 1 and (said[s].startswith("album") or fits(mine[0][2])):
            return mine[0][2], "album", mine[0][1]
        return None, None, None

    q = spark.createDataFrame(list(said.items()), "session long, query string")
    t = spark.createDataFrame(tracks, "session long, ord long, artist string, own boolean, inferred boolean")
    got = {r.session: (r.artist, r.via, r.ord) for r in choosing.shortcuts(q, t, spark.createDataFrame(albums, "session long, ord long, artist string")).collect()}
    assert got == {s: choose(s) for s in said} and {v[1] for v in got.values()} == {None, "exact", "dominant", "album"}
