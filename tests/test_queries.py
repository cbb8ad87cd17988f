"""Every query against its SQL on the smallest tables."""

import compare
import pytest
from compare import SF

from skeinwork.plans import registry


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, con, name):
    assert compare.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name]) is None


def test_sql_is_only_of_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_greedy_match(spark):
    from skeinwork.operators.matching import match_greedily

    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x"), (2, 2, "y")], "g long, l_ord long, l_key string")
    right = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 1, "y"), (2, 2, "q")], "g long, r_ord long, r_key string")
    got = sorted(map(tuple, match_greedily(left, right, "g").collect()))
    assert got == [(1, 1, 2), (1, 3, 1), (2, 2, 1)]


def test_cooldown(spark):
    import datetime

    from skeinwork.operators.matching import cooldown

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(11)), (1, at(20)), (2, at(1))], "k long, ts timestamp_ntz")
    got = {(r.k, r.ts.minute): r.accepted for r in cooldown(rows, "k", "ts", 600).collect()}
    assert got == {(1, 0): True, (1, 5): False, (1, 11): True, (1, 20): False, (2, 1): True}


def test_match_by_score_is_greedy(spark):
    import random

    from skeinwork.operators.matching import match_by_score, track_levels, with_track_keys

    rng = random.Random(8)
    artists, titles = ["Ali", "Ali & Reza", "Reza, Ali", "reza x ali", None, ""], ["Love", "love!", "Love (feat. Z)", "Love Remix", "Yar", None]
    rows = lambda n: [(rng.randrange(4), i, rng.choice(artists), rng.choice(titles)) for i in range(n)]
    left, right = rows(60), rows(50)
    norm = lambda x: "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()
    members = lambda x: sorted(w for w in norm(x) if w != "x")  # noqa: E731  all members here are single words
    core = lambda x: [w for w in norm((x or "").split("(")[0])]

    def score(a, b):
        if not norm(a[3]) or not norm(b[3]):
            return None
        points = 8 if norm(a[3]) == norm(b[3]) else 5 if core(a[3]) == core(b[3]) else None
        if points is None or not norm(a[2]) or not norm(b[2]):
            return points
        return points + 4 if norm(a[2]) == norm(b[2]) else points + 2 if members(a[2]) == members(b[2]) else None

    # levels of one score with a blank artist on the left come before those with one on the right
    every = sorted((-s, bool(norm(a[2])), a[1], b[1], a[0]) for a in left for b in right if a[0] == b[0] and (s := score(a, b)) is not None)
    want, used = set(), set()
    for s, _, i, j, g in every:
        if ("l", g, i) not in used and ("r", g, j) not in used:
            used |= {("l", g, i), ("r", g, j)}
            want.add((g, i, j, -s))
    l, r = spark.createDataFrame(left, "g int, l_ord int, artist string, title string"), spark.createDataFrame(right, "g int, r_ord int, artist string, title string")
    l, r = (with_track_keys(x, "artist", "title") for x in (l, r))
    assert {tuple(x) for x in match_by_score(l, r, "g", track_levels()).collect()} == want and len(want) > 20
