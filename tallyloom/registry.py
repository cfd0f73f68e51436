"""Named queries of the library, with the SQL that must give the same rows.

A query is a function of the civic tables; ``named`` registers it under its
own name together with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.civic import civic, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def named(sql: str | None = None) -> Callable:
    """Register a function of the civic tables; without SQL only its rows are checked."""

    def add(f: Callable) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(civic(spark, sf_dir))

        query.__name__, query.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = query
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from .operators import conflicts, evidence, identity, people, planning, procurement, records, sponsorship, validation, verification  # noqa: F401
    from .plans import battery, digest, gates  # noqa: F401  (after the operators, whose SQL they use)
    from .streaming import windows  # noqa: F401


load()
