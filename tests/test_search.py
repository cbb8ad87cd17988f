"""Query ranking on the domain's cases."""

import random
import re

from pyspark.sql import functions as F

from skeinwork.operators import search


TRACKS = [
    ("25Band", "Delam"), ("25 Band Tribute", "Delam"), ("Other", "Delam"), ("Hichkas", "Bunbast"), ("Hichkas", "Mojaz"), ("Reza Bahram", "Atash Remix"), ("Reza Bahram", "Atash"),
    ("Ali Sorena", "Atash"), ("Farhad Ravanbakhsh", "X"), ("Farhad", "Y"), ("A", "Song"), ("The", "Album"), ("Mohammad Reza Shajarian", "X"),
]
#: What a query finds best, and what is kept for it.
FOUND = {
    "25 Band Delam": (0, {0}), "hichkas mojaz": (4, {4}), "Reza Bahram Atash": (6, {6}), "رضا بهرام Atash": (6, {6}), "Farhad": (9, {9}), "download song": (10, {10}), "the album": (None, set()),
    "هیچکس": (3, {3, 4}), "محمدرضا شجریان": (12, {12}),
}


def _tables(spark, queries, tracks):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return q, spark.createDataFrame([(i, a, x, i) for i, (a, x) in enumerate(tracks)], "track_id long, artist string, title string, ordinal int")


def test_ranking(spark):
    q, t = _tables(spark, FOUND, TRACKS)
    kept = {}
    for r in search.keep_full(q, t).collect():
        kept.setdefault(r.query_id, set()).add(r.track_id)
    best = {r.query_id: r.track_id for r in search.top(q, t, 1).collect()}
    assert {x: (best.get(i), kept.get(i, set())) for i, x in enumerate(FOUND)} == FOUND


def test_consensus_of_the_other_script(spark):
    said = ["آهنگ دلم"]
    for tracks, want in (([("Ahang Delam", str(i)) for i in range(4)] + [("Other", "x")], {0, 1, 2, 3}), ([("Ahang Delam", "a"), ("Other", "x")], set())):
        assert {r.track_id for r in search.keep_full(*_tables(spark, said, tracks)).collect()} == want


def test_every_hundredth_part_asks(spark, tmp_path):
    from skeinwork.plans import registry

    rows = [(k, f"Brand#{10 + k % 7}", f"{('red', 'blue', 'cold')[k % 3]} {('rod', 'bolt')[k % 2]}") for k in range(0, 620, 10)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    same = lambda i, j: rows[i // 10][1:] == rows[j // 10][1:]  # noqa: E731  all words of a query are those of its brand and name
    want = {(q, t) for q in range(0, 620, 100) for t in range(0, 620, 10) if same(q, t)}
    got = {(r.query_id, r.track_id) for r in registry.QUERIES["full_coverage_filter"](spark, str(tmp_path)).collect()}
    assert got == want
    ranked = registry.QUERIES["query_score_rank"](spark, str(tmp_path)).filter("place = 1").collect()
    assert {(r.query_id, r.track_id) for r in ranked} == {(q, min(t for i, t in want if i == q)) for q in range(0, 620, 100)}


def _skeleton(word):
    from skeinwork.functions.text import CONSONANTS, VOWEL_SIGNS

    word = word.lower()
    if re.search("[\u0600-\u06ff]", word):
        return "".join(CONSONANTS.get(c, "") for i, c in enumerate(word) if c not in VOWEL_SIGNS and not (c in "یيى" and i == len(word) - 1) and not (c == "و" and i))
    return re.sub("[aeiou]+", "", re.sub("[^a-z0-9]+", "", word))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _close(a, b, one, two):
    allowed = 2 if max(len(a), len(b)) >= two else 1 if max(len(a), len(b)) >= one else 0
    return bool(a and b) and _edits(a, b) <= allowed


def _crossed(left, right, loose=True):
    arabic = [bool(re.search("[\u0600-\u06ff]", x)) for x in (left, right)]
    if arabic[0] == arabic[1] or not all(y or re.search("[A-Za-z]", x) for x, y in zip((left, right), arabic)):
        return False
    a, b = [_skeleton(x) for x in left.split()], [_skeleton(x) for x in right.split()]
    if len(a) == len(b) and all(_close(x, y, 4, 99) for x, y in zip(a, b)) or len(a) != len(b) and _close("".join(a), "".join(b), 6, 9):
        return True
    return loose and len(a) >= 2 and len(b) >= 2 and _close("".join(a), "".join(b), 7, 9)


def _brute(query, tracks):
    """{track: (score, coverage)}, and the kept ones, by the definitions over all pairs."""
    from skeinwork.functions.text import VARIANT_KINDS

    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    canon = lambda x: f"@variant:{VARIANT_KINDS[x]}" if x in VARIANT_KINDS else x
    raw = norm(query).split()
    words = [x for x in raw if len(x) >= 2 and x not in search.NOISE]
    tokens, kinds = [canon(x) for x in words], {VARIANT_KINDS[x] for x in raw if x in VARIANT_KINDS}
    found = {}
    for i, (artist, title) in enumerate(tracks):
        fields = [[canon(x) for x in norm(f).split()] for f in (artist, title)]
        seen, compact = [x in fields[0] + fields[1] for x in tokens], {"".join(f) for f in fields if f}
        at = 0
        while at < len(tokens):
            if not seen[at]:
                for stop in range(at + 1, len(tokens) + 1):
                    if stop - 1 > at and seen[stop - 1]:
                        break
                    if "".join(tokens[at:stop]) in compact:
                        seen[at:stop] = [True] * (stop - at)
                        break
            at += 1
        for f in (artist, title):
            runs = [(n, a) for n in range(len(tokens), 0, -1) for a in range(len(tokens) - n + 1) if not any(x[0] == "@" for x in tokens[a : a + n]) and _crossed(" ".join(tokens[a : a + n]), f)]
            if runs:
                n, a = runs[0]
                seen[a : a + n] = [True] * n
        whole = lambda f: any("".join(map(canon, s[a:b])) == "".join(map(canon, norm(f).split())) or not {*s[a:b]} & {*VARIANT_KINDS} and _crossed(" ".join(s[a:b]), f) for s in (raw, words) for a in range(len(s)) for b in range(a + 1, len(s) + 1)) and bool(norm(f))
        unasked = sum(x in VARIANT_KINDS and VARIANT_KINDS[x] not in kinds for x in norm(title).split())
        score = 10 * sum(seen) + 8 * (norm(title) in norm(query)) + 6 * (norm(artist) in norm(query)) - 18 * unasked
        found[i] = (score, sum(seen), unasked, whole(artist), whole(title))
    full = {i: x for i, x in found.items() if x[1] == len(tokens)}
    if not tokens:
        kept = set()
    elif len(tokens) == 1:
        kept = {i for i, x in full.items() if x[3] or x[4]}
    elif full:
        clean = {i: x for i, x in full.items() if not x[2]} or full
        kept = {i for i, x in clean.items() if x[3]} or {*clean}
    else:
        kept = {i for i, (a, b) in enumerate(tracks) if _crossed(query, a, False) or _crossed(query, b, False)}
    return {i: x[:2] for i, x in found.items() if x[1]}, kept


def test_equal_to_all_pairs(spark):
    rng = random.Random(2)
    names = ["Reza", "Bahram", "رضا", "بهرام", "محمدرضا", "Mohammad Reza", "شجریان", "Shajaryan", "25 Band", "25Band", "Gole Yakh", "گل یخ", "Remix", "Live", "Khoob", "خوب", "روز", "Rooze", "میاد", "Miad", "یه", "Ye", "Delam", "دلم"]
    pick = lambda n: " ".join(rng.choice(names) for _ in range(rng.randint(1, n)))
    tracks, queries = [(pick(2), pick(4)) for _ in range(150)], [pick(4) for _ in range(40)] + ["Ye Rooze Khoob Miad", "the", ""]
    tracks += tracks[:5] + [("x", "یه روز خوب میاد")]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    t = spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(tracks)], "track_id long, artist string, title string, ordinal int")
    got, kept = {}, {}
    for r in search.top(q, t, 7).collect():
        got.setdefault(r.query_id, []).append((r.place, r.track_id, r.score, r.coverage))
    for r in search.keep_full(q, t).collect():
        kept.setdefault(r.query_id, set()).add(r.track_id)
    for k, x in enumerate(queries):
        scores, keep = _brute(x, tracks)
        best = sorted(scores.items(), key=lambda y: (-y[1][0], -y[1][1], y[0]))[:7]
        assert sorted(got.get(k, [])) == [(n, i, *y) for n, (i, y) in enumerate(best, 1)], x
        assert kept.get(k, set()) == keep, x


def test_inferred_artists_and_copies(spark):
    q = spark.createDataFrame([(1, "ali delam"), (2, "ali delam")], "query_id long, query string")
    t = spark.createDataFrame([(i, "Ali", "Delam", 9 - i, i == 3) for i in range(4)] + [(9, None, None, 0, None)], "track_id long, artist string, title string, ordinal int, artist_inferred boolean")
    rows = search.top(q, t, 3).collect()
    assert {(r.query_id, r.place): r.track_id for r in rows} == {(x, k): i for x in (1, 2) for k, i in ((1, 2), (2, 1), (3, 0))}
    assert {(r.track_id, r.score) for r in search.keep_full(q, t).collect()} == {(0, 34), (1, 34), (2, 34), (3, 33)}


def test_plan(spark):
    said = ["Ali feat. Reza", "Ali feat Reza remix", "  Ali ", "", None, "آهنگ ft. علی بی کلام", "feat x"]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").orderBy("i").select(search.plan(F.col("s")).alias("p")).collect()]
    assert got == [["Ali", "Ali feat. Reza"], ["Ali feat Reza remix", "Ali"], ["Ali"], [], [], ["آهنگ ft. علی بی کلام", "آهنگ"], ["feat x"]]
