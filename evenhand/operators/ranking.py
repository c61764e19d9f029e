"""Exact ranks, cuts and quantiles of groups of any size.

A plain ``row_number()`` over a class sorts the class in one task. Here every
group is first split into buckets that follow the sort order; bucket counts are
small, their prefix sums give each bucket's offset, and rows are sorted only
inside buckets. Results are exact and equal to the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.hashing import SEED, hash32
from evenhand.functions.radix import digits
from evenhand.session import settle

HASH_BUCKET_BITS = 16  # 65,536 buckets per group


def hash_bucket(h: Column, bits: int = HASH_BUCKET_BITS) -> Column:
    """Leading bits of a 32-bit hash: follows the order of the hash."""
    return F.shiftright(h, 32 - bits)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right keys are not repeated.

    Without keys this would pair all rows with all rows, so there must be one.
    """
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """(keys, bucket, _n, _off): rows per bucket and rows in the buckets before it."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "idx",
    size: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group, in the order of ``order``.

    ``bucket`` must be an integer that never decreases along ``order``. ``size``
    names a column for the number of rows in the group.
    """
    rows = df.withColumn("_b", bucket)
    offsets = bucket_offsets(rows.select(*keys, "_b"), keys, "_b")
    if size is not None:
        offsets = offsets.withColumn(size, F.sum("_n").over(Window.partitionBy(*keys)))
    offsets = offsets.drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inside))
    joined = null_safe_join(ranked, offsets, [*keys, "_b"])
    return joined.withColumn(name, F.col("_off") + F.col("_rn") - 1).drop("_b", "_rn", "_off")


def cut_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
    limits: DataFrame | int, limit: str = "limit",
) -> DataFrame:
    """The ``limit``-th row of each group as a struct ``cut`` of the order columns.

    ``limits`` is one number for all groups, or a table of the group keys, the limit
    and any further columns, which are carried along; several limits per group are
    allowed. Limits below 1 or above the group size give no row. Only the one bucket
    that a limit falls into is sorted, and only keys and order columns are read.
    """
    slim = df.select(*dict.fromkeys([*keys, *order]), bucket.alias("_b"))
    offsets = bucket_offsets(slim, keys, "_b")
    if isinstance(limits, int):
        extra = []
        candidates = offsets.withColumn("_limit", F.lit(limits).cast("bigint"))
    else:
        named = limits.withColumnRenamed(limit, "_limit")
        extra = [c for c in named.columns if c not in keys and c != "_limit"]
        candidates = null_safe_join(offsets, named, keys)
    wanted = (
        candidates.where((F.col("_off") < F.col("_limit")) & (F.col("_limit") <= F.col("_off") + F.col("_n")))
        .withColumn("_need", F.col("_limit") - F.col("_off")).drop("_n", "_off")
    )
    wanted = settle(wanted, "wanted")  # a few buckets: only their rows are shuffled below
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    needed = null_safe_join(slim, wanted.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    ranked = needed.withColumn("_rn", F.row_number().over(inside))
    found = null_safe_join(ranked, wanted, [*keys, "_b"]).where(F.col("_rn") == F.col("_need"))
    return found.select(*keys, *extra, F.col("_limit").alias(limit), F.struct(*order).alias("cut"))


def take_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    limits: DataFrame | int,
    limit: str = "limit",
) -> DataFrame:
    """Rows among the first ``limit`` of their group; groups smaller than that are kept whole.

    ``order`` must identify a row within its group. Only keys and order columns are
    read to find one cut per group; wide rows are then compared with the cuts and
    are not shuffled as long as the table of cuts can be broadcast. Groups that a
    table of limits does not list are left out.
    """
    before_cut = F.col("cut").isNull() | (F.struct(*order) <= F.col("cut"))
    if isinstance(limits, int):
        if limits <= 0:
            return df.where(F.lit(False))
        cuts = settle(cut_points(df, keys, order, bucket, limits).select(*keys, "cut"), "cuts")
        return null_safe_join(df, cuts, keys, "left").where(before_cut).drop("cut")
    cuts = cut_points(df, keys, order, bucket, limits, limit).select(*keys, "cut")
    table = settle(null_safe_join(limits.select(*keys, limit), cuts, keys, "left"), "cuts")
    return null_safe_join(df, table, keys).where((F.col(limit) > 0) & before_cut).drop("cut", limit)


def sample_per_group(df: DataFrame, keys: Sequence[str], item: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows per group without replacement, by smallest seeded hash of ``item``.

    ``item`` must be unique within its group. One hash cut per group decides, so wide
    rows are only compared with the cut of their group.
    """
    rows = df.withColumn("_h", hash32(F.col(item), seed=seed))
    return take_first(rows, list(keys), ["_h", item], hash_bucket(F.col("_h")), n).drop("_h")


def value_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): distinct values with their counts; NULL and NaN are left out."""
    v = F.col(value)
    return (
        df.select(*keys, v.cast("double").alias(value)).where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation between closest ranks.

    Same result as ``percentile``, whose state is a map of all distinct values of
    a group in one task; here each wanted rank is narrowed down digit by digit.
    NULL and NaN are ignored. With ``weight`` the rows are distinct values that
    stand for that many rows, as from :func:`value_cells`. Large inputs are reduced
    to distinct values once and written; each level then scans these.
    """
    keys = list(keys)
    if weight is None:
        cells = settle(value_cells(df, keys, value), "values")
    else:
        v = F.col(value).cast("double")
        cells = df.withColumns({value: v, "n": F.col(weight)}).where(v.isNotNull() & ~F.isnan(v))
    coarse, fine = digits(F.col("_v"))
    cells = cells.select(*keys, F.col(value).alias("_v"), F.col("n").alias("_n")).withColumns(
        {"_c": coarse, "_f": fine})
    inside = (F.col("_off") <= F.col("_pos")) & (F.col("_pos") < F.col("_off") + F.col("_n"))

    # Level 1: the coarse digit that holds each wanted rank (floor and ceiling of the exact position).
    whole = Window.partitionBy(*keys)
    level1 = cells.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"))
    level1 = level1.withColumns({
        "_off": F.sum("_n").over(whole.orderBy("_c")) - F.col("_n"), "_total": F.sum("_n").over(whole)})
    exact = [((F.col("_total") - 1) * F.lit(float(p))) for p in probs]
    ranks = F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), e.alias("_exact"), F.lit(side).alias("_side"),
                 pick(e).cast("bigint").alias("_pos"))
        for p, e in zip(probs, exact) for side, pick in enumerate((F.floor, F.ceil))
    ]))
    target = ["prob", "_exact", "_side", "_pos"]
    wanted = level1.select(*keys, "_c", "_n", "_off", ranks).where(inside).select(
        *keys, "_c", *target, F.col("_off").alias("_base"))
    wanted = settle(wanted, "wanted")

    # Level 2: the fine digit; only cells of the wanted coarse digits go on.
    near = null_safe_join(cells, wanted, [*keys, "_c"])
    group = [*keys, *target, "_c"]
    level2 = near.groupBy(*group, "_f", "_base").agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_f")) - F.col("_n")
    wanted2 = level2.withColumn("_off", F.col("_base") + before).where(inside).select(
        *keys, "_c", "_f", *target, F.col("_off").alias("_base"))
    wanted2 = settle(wanted2, "wanted")

    # Level 3: the value itself.
    last = null_safe_join(cells, wanted2, [*keys, "_c", "_f"])
    before = F.sum("_n").over(Window.partitionBy(*group, "_f").orderBy("_v")) - F.col("_n")
    found = last.withColumn("_off", F.col("_base") + before).where(inside)
    low = F.max(F.when(F.col("_side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_v")))
    share = F.max(F.col("_exact") - F.floor("_exact"))
    return found.groupBy(*keys, "prob").agg((low + (high - low) * share).alias("quantile"))
