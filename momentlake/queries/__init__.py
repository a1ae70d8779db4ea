"""The registered queries: each applies operators to whole driver tables; SQL gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from momentlake.queries import indexes, jobs, moments, records, vectors

_MODULES = (moments, records, vectors, indexes, jobs)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
