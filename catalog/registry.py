"""Query registry: a Spark callable and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _names(text: str) -> list[str]:
    return text.split()


def query(name: str, sql: str | None = None, ints: str = "", doubles: str = ""):
    """Register a query. ``ints`` and ``doubles`` fix types and rounding on both sides."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            df = df.withColumns({c: F.col(c).cast("bigint") for c in _names(ints)})
            return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in _names(doubles)})

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            changes = [f"CAST({c} AS BIGINT) AS {c}" for c in _names(ints)]
            changes += [f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in _names(doubles)]
            replace = f"* REPLACE ({', '.join(changes)})" if changes else "*"
            SQL[name] = f"SELECT {replace} FROM (\n{sql.strip()}\n) AS result"
        return build

    return register
