"""All registered queries of the catalog operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.plans import choosing, decisions, evidence, naming, ranking, relational, streams, textual, versions, wording

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _family in (relational.catalogue, textual.catalogue, versions.catalogue, streams.catalogue, ranking.catalogue, decisions.catalogue, naming.catalogue, choosing.catalogue, evidence.catalogue, wording.catalogue):
    QUERIES |= _family.queries
    ORACLE_SQL |= _family.sql

#: The query that ``entry`` runs.
FLAGSHIP = "identity_topk_per_group"
