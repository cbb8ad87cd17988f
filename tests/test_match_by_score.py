"""Matching by score at size: keys of spellings once, and of rows with partners only."""

import compare
import pandas as pd
from compare import SF

from skeinwork.plans import registry


def _tables(tmp_path, lines, parts):
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).astype({"l_orderkey": "int64", "l_linenumber": "int32", "l_partkey": "Int64", "l_suppkey": "int64"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame(parts, columns=["p_partkey", "p_name", "p_brand", "p_size"]).astype({"p_size": "Int32"}).to_parquet(tmp_path / "part.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    return con


def test_only_rows_with_partners_are_keyed(spark, monkeypatch):
    """Before, the keys of all lines were worked out and written, twice; few lines have one of their name in the next order."""
    from skeinwork.operators import matching

    written = {}

    def keep(df, label, **options):
        out = materialize(df, label, **options)
        written.setdefault(label, []).append(out.count())
        return out

    materialize = matching.materialize
    monkeypatch.setattr(matching, "materialize", keep)
    con = compare.connect(SF)
    assert compare.differences(registry.QUERIES["match_by_score"](spark, SF), con, registry.ORACLE_SQL["match_by_score"]) is None
    of = "SELECT DISTINCT l_orderkey AS g, l_linenumber AS n, first_value(p_name) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS t FROM lineitem JOIN part ON p_partkey = l_partkey"
    want = [con.execute(f"WITH l AS ({of}) SELECT count(*) FROM l WHERE EXISTS (SELECT 1 FROM l o WHERE o.g = l.g + {by} AND o.t = l.t)").fetchall()[0][0] for by in (1, -1)]
    assert written["keys"] == want and sum(want) > 100
    assert written["spellings"][0] <= con.execute("SELECT 4 * count(DISTINCT (p_name, p_brand)) FROM part").fetchall()[0][0]


def test_lines_without_a_part(spark, tmp_path):
    """Lines of one number of which one names no part, and keys of parts that stand twice: as the SQL has it."""
    lines = [(1, 1, None, 1, 1.0), (1, 1, 7, 2, 2.0), (1, 2, 8, 1, 1.0), (2, 1, 7, 1, 1.0), (2, 2, None, 1, 1.0), (2, 3, 9, 1, 1.0), (3, 1, 9, 1, 1.0)]
    parts = [(7, "red bolt", "Brand#1", 5), (8, "old ring", "Brand#2", 4), (9, "old ring", "Brand#3", 3), (9, "red bolt", "Brand#1", None)]
    con = _tables(tmp_path, lines, parts)
    got = registry.QUERIES["match_by_score"](spark, str(tmp_path))
    assert compare.differences(got, con, registry.ORACLE_SQL["match_by_score"]) is None and got.count() > 2


def test_partners_change_no_pair(spark):
    """Rows with partners give the pairs of all rows, for every level."""
    import random

    from pyspark.sql import functions as F

    from skeinwork.operators import matching

    rng = random.Random(3)
    artists, titles = ["Ali & Reza", "Reza, Ali", "reza x ali", None, ""], ["Love", "love!", "Love (feat. Z)", "Love Remix", "Yar (Live)", "yar live", "", "(feat. Z)", "|", None]
    made = [(i, rng.choice(artists), rng.choice(titles)) for i in range(60)]
    items = spark.createDataFrame(made, "item long, artist string, title string")
    one, two = ([(rng.randrange(12), i, rng.randrange(60)) for i in range(80)] for _ in range(2))
    left, right = spark.createDataFrame(one, "g long, l_ord long, item long"), spark.createDataFrame([*two, (None, 99, 0)], "g long, r_ord long, item long")
    spelled = matching.spelled(items, matching.track_spellings(items.unionByName(items)))
    assert spelled.count() == 60
    rows = None
    for side, (x, o) in enumerate(((left, "l_ord"), (right, "r_ord"))):
        x = x.join(spelled, "item").select("g", F.lit(side).alias("side"), F.col(o).alias("ord"), "item", F.explode("_blocks").alias("block"))
        rows = x if rows is None else rows.unionByName(x)
    near = [x.join(spelled, "item") for x in matching.with_partners(rows, "g", "item")]
    every = [matching.with_track_keys(x.join(items, "item"), "artist", "title") for x in (left, right)]
    got, want = ({tuple(r) for r in matching.match_by_score(*x, "g", matching.track_levels()).collect()} for x in (near, every))
    assert got == want and {s for *_, s in want} >= {12, 10, 8, 5}
    assert near[0].count() + near[1].count() < 160
