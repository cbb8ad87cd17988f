"""The best candidate of each part: rows that sf0.001 has not, and no pairs of all parts of a name."""

import random

import duckdb

from skeinwork.plans import registry


def made(spark, folder, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return registry.QUERIES["best_candidate_match"](spark, str(folder))


def test_odd_parts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(150)]), rng.choice(["Old Song", "old-song", "Other", "?", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 9, 14, 15, 30, 43, 60])) for _ in range(260)]
    rows += [(500, "Alone", None, 5), (501, "alone", "a", 17), (502, "ALONE", "a", 30), (503, "Pair", None, 1), (504, "Pair", None, 3), (505, "Pair", "z", 1)]
    got = {tuple(r) for r in made(spark, tmp_path, rows).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == set(con.execute(registry.ORACLE_SQL["best_candidate_match"]).fetchall())
    assert any(s is None for _, _, s in got) and any(s is not None and s <= 0 for _, _, s in got)


def test_parts_of_one_name_are_not_paired(spark, tmp_path):
    """40,000 parts of one name, brand and size are 1.6e9 pairs, which would not end in this time."""
    made(spark, tmp_path / "x", [(i, "Same", "b", 7) for i in range(3)]).collect()
    spark.range(40000).selectExpr("id AS p_partkey", "'Same' AS p_name", "'b' AS p_brand", "7 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.QUERIES["best_candidate_match"](spark, str(tmp_path))
    joined = "\n".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert "abs((p_size" not in joined  # no join that pairs parts by how near their sizes are
    assert found.groupBy("match", "score").count().orderBy("match").collect() == [(0, 100, 39999), (1, 100, 1)]
