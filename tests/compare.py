"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import datetime
import math

#: The tables that tests read.
SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    want, got = rows(names, made.fetchall()), rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9)) or (isinstance(y, float) and x == y) for x, y in zip(a, b))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
