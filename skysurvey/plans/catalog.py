"""Registry of the engine's queries and of their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysurvey.plans import format_queries, io_queries, raster_queries, scene_queries, set_queries, survey_queries

_MODULES = (format_queries, io_queries, raster_queries, scene_queries, set_queries, survey_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
