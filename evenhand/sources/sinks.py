"""Sinks: result tables, reports, splits, and the resumable batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flat result table with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_predictions(df: DataFrame, folder: str, model: str = "model", mode: str = "overwrite") -> None:
    """All models in one pass: a ``file=<tag>_predictions.csv`` folder each, as ``read_predictions`` expects."""
    named = df.withColumn("file", F.concat(F.col(model), F.lit("_predictions.csv"))).drop(model)
    named.write.mode(mode).partitionBy("file").option("header", True).csv(folder)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, for tables that other jobs read; arrays stay arrays."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


MOST_REPORT_ROWS = 100_000


def report_json(sections: Mapping[str, DataFrame], most_rows: int = MOST_REPORT_ROWS) -> DataFrame:
    """One row with a JSON document: each small result table becomes a list of records.

    For result tables, whose size does not grow with the data. A table of more than
    ``most_rows`` rows makes the report fail before its rows are gathered; write such a
    table with ``write_json_lines``.
    """
    names = list(sections)
    first = sections[names[0]].sparkSession.range(1)

    def listed(table: DataFrame) -> DataFrame:
        bounded = table.limit(most_rows + 1)  # one row too many is enough to fail
        rows = F.array_sort(F.collect_list(F.struct(*table.columns)))
        return bounded.agg(F.when(F.count(F.lit(1)) <= most_rows, rows).otherwise(
            F.raise_error(F.lit(f"a report section has more than {most_rows} rows")).cast(f"array<{table.schema.simpleString()}>")))

    columns = [listed(sections[n]).scalar().alias(n) for n in names]
    return first.select(*columns).select(F.to_json(F.struct(*names)).alias("value"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).text(path)


def write_json_lines(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """JSON lines, one folder per split if ``partition_by`` says so."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def write_kept_and_filtered(df: DataFrame, keep, path: str, mode: str = "overwrite") -> None:
    """Both sides of a predicate in one pass, as folders ``kept=true`` and ``kept=false``."""
    df.withColumn("kept", F.coalesce(keep, F.lit(False))).write.mode(mode).partitionBy("kept").parquet(path)


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Input rows that are not in the sink yet."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def resume_batch(
    source: DataFrame, path: str, key: str, transform: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Append ``transform`` of the pending rows to the Parquet sink and return the sink.

    Running it again after a failure continues with what is missing: the committer
    publishes a run's files only when the run is complete.
    """
    spark = source.sparkSession
    try:
        todo = pending(source, spark.read.parquet(path), key)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        todo = source
    transform(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
