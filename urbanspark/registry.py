"""Every registered query and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urbanspark.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; oracle: the same query in DuckDB SQL, free to name the views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from urbanspark.plans import economy, fit, geo, grids, joins, journeys, lines, measures, more, network, text, timetable, windows  # noqa: F401
