"""Quantiles from mergeable sketches, kept per group and file and merged later.

A sketch holds some hundred values whatever it has seen. Sketches of parts are merged
without the rows, so a new file costs one pass over that file only. Below ``size`` values
a sketch holds them all and its quantiles are values of the data at the exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SKETCH_SIZE = 800


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of the rows by which a quantile's rank may be off, in 99 of 100 cases (published fit for one rank)."""
    return 2.296 / size ** 0.9723


def value_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(by, n, sketch); NULL and nan are left out, a group without values has no row."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size))
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("sketch"))


def file_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(file, by, n, sketch) of a table that is read from files: the state to be kept."""
    return value_sketches(df.select(F.col("_metadata.file_path").alias("file"), *by, value), ["file", *by], value, size)


def merged_sketches(sketches: DataFrame, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(by, n, sketch) of all sketches of a group."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, n, prob, quantile): a value of the data whose rank is near ``prob``."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    found = sketches.select(*by, "n", F.explode(F.arrays_zip(
        asked.alias("prob"), F.kll_sketch_get_quantile_double("sketch", asked).alias("quantile"))).alias("_q"))
    return found.select(*by, "n", "_q.prob", "_q.quantile")
