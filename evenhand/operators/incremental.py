"""Aggregates kept up to date: cells are stored with the files that they cover.

A run lists the input, reads only files that the store does not cover, reduces them to
cells and appends these with the file's path and version. Metrics are computed from the
stored cells, so a rerun costs the new files alone. Files that were overwritten count
with their present version, files that are gone no longer count, and a file that two
runs have added counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.session import settle

FILE, VERSION, RUN, EMPTY = "_file", "_version", "_run", "_empty"


def file_version() -> list:
    """Path and version (time and size) of the file that a row comes from."""
    version = F.concat_ws("-", F.unix_micros("_metadata.file_modification_time"), F.col("_metadata.file_size"))
    return [F.col("_metadata.file_path").alias(FILE), version.alias(VERSION)]


def listed_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, _file, _version) of the input as it is now; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", *file_version())


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def update_cells(spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame],
                 cells: Callable[[DataFrame, Sequence[str]], DataFrame], pattern: str = "*.parquet") -> int:
    """Add the files of ``folder`` that ``store`` does not cover; returns how many there were.

    ``read`` makes a table of a list of paths, which must come straight from the files;
    ``cells`` reduces it to additive cells, given the two columns to keep apart. A file
    without cells is remembered too.
    """
    files = listed_files(spark, folder, pattern)
    known = stored(spark, store)
    if known is not None:
        files = files.join(known.select(FILE, VERSION).distinct(), [FILE, VERSION], "left_anti")
    new = files.collect()  # names, as a reader lists them
    if not new:
        return 0
    rows = read([r["path"] for r in new]).select("*", *file_version())
    made = cells(rows, [FILE, VERSION]).withColumn(EMPTY, F.lit(False))
    seen = spark.createDataFrame([(r[FILE], r[VERSION], True) for r in new], f"{FILE} string, {VERSION} string, {EMPTY} boolean")
    made.unionByName(seen, allowMissingColumns=True).withColumn(RUN, F.lit(uuid.uuid4().hex)).write.mode("append").parquet(store)
    return len(new)


def current_cells(spark: SparkSession, folder: str, store: str, sums: Sequence[str], pattern: str = "*.parquet") -> DataFrame:
    """The cells of all files that are in ``folder`` now, added up over files."""
    known = stored(spark, store)
    if known is None:
        raise FileNotFoundError(f"no cells in {store}")
    one_run = settle(known.groupBy(FILE, VERSION).agg(F.min(RUN).alias(RUN)).join(
        listed_files(spark, folder, pattern).select(FILE, VERSION), [FILE, VERSION], "left_semi"), "covered")
    valid = known.where(~F.col(EMPTY)).join(one_run, [FILE, VERSION, RUN], "left_semi")
    keys = [c for c in known.columns if c not in (*sums, FILE, VERSION, RUN, EMPTY)]
    return valid.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
