"""Registration of queries: each has a name, a function of its tables, and DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.runtime import table

#: The time that stands for now.
AS_OF = "2024-01-31 00:00:00"

Tables = Callable[[str], DataFrame]


class Catalogue:
    """Queries of one family and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function of a table loader under its own name."""

        def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
