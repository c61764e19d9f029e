"""Class caps and stratified splits with exact sizes, by seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.hashing import SEED, hash32, uniform
from evenhand.operators.ranking import cut_points, hash_bucket, null_safe_join, sample_per_group, take_first
from evenhand.session import settle

__all__ = ["cap_per_class", "hash_split", "sample_per_class", "stratified_split", "predefined_split"]


def sample_per_class(df: DataFrame, label: str, item: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows per class, or all of a smaller class."""
    return sample_per_group(df, [label], item, n, seed)


def sample_budget_per_class(
    df: DataFrame, label: str, item: str, budget: int, seed: int = SEED
) -> DataFrame:
    """At most ``budget`` rows in all, ``budget div classes`` of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = F.count(F.lit(1)).over(Window.partitionBy())  # one row per class
    limits = counts.select(label, F.floor(F.lit(budget) / classes).cast("bigint").alias("limit"))
    rows = df.withColumn("_h", hash32(F.col(item), seed=seed))
    return take_first(rows, [label], ["_h", item], hash_bucket(F.col("_h")), limits).drop("_h")


def cap_per_class(
    df: DataFrame, label: str, item: str, cap: int, seed: int = SEED, only: Column | None = None
) -> DataFrame:
    """Cut classes above ``cap`` down to it; rows outside ``only`` (say the train split) stay."""
    if cap <= 0:
        return df
    if only is None:
        return sample_per_group(df, [label], item, cap, seed)
    inside = sample_per_group(df.where(only), [label], item, cap, seed)
    return inside.unionByName(df.where(~F.coalesce(only, F.lit(False))))


def _allocate(counts: DataFrame, label: Sequence[str], size: str, held: Column, name: str) -> DataFrame:
    """Largest-remainder share of ``held`` rows per class; ``counts`` has one row per class.

    Integer arithmetic on decimals, so shares are exact; equal remainders go to
    the first class names.
    """
    whole = Window.partitionBy()
    parts = counts.withColumn("_t", F.sum(size).over(whole)).withColumn("_h", held)
    product = F.col(size).cast("decimal(38,0)") * F.col("_h").cast("decimal(20,0)")
    parts = parts.withColumns({
        "_q": F.when(F.col("_t") > 0, F.floor(product / F.greatest("_t", F.lit(1)))).otherwise(0).cast("bigint"),
    }).withColumn("_r", product - F.col("_q").cast("decimal(20,0)") * F.col("_t").cast("decimal(18,0)"))
    parts = parts.withColumns({
        "_left": F.col("_h") - F.sum("_q").over(whole),
        "_rank": F.row_number().over(whole.orderBy(F.desc("_r"), *label)),
    })
    share = F.col("_q") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return parts.withColumn(name, share.cast("bigint")).drop("_t", "_h", "_q", "_r", "_left", "_rank")


def split_sizes(
    counts: DataFrame, label: Sequence[str], holdout: Sequence[float], names: Sequence[str], size: str = "n"
) -> DataFrame:
    """(label, n, n_<name>...) for successive hold-outs.

    Each fraction holds out ``ceil(fraction * remaining)`` rows in all; the rest of
    that step is the next named part. Classes share a part in proportion to their
    size, by largest remainder.
    """
    if len(names) != len(holdout) + 1:
        raise ValueError("one name more than hold-out fractions is needed")
    whole = Window.partitionBy()
    table = counts.withColumn("_rest", F.col(size))
    for fraction, name in zip(holdout, names):
        total = F.sum("_rest").over(whole)
        table = table.withColumn("_keep", total - F.ceil(total * F.lit(float(fraction))).cast("bigint"))
        table = _allocate(table, label, "_rest", F.col("_keep"), f"n_{name}")
        table = table.withColumn("_rest", F.col("_rest") - F.col(f"n_{name}")).drop("_keep")
    return table.withColumnRenamed("_rest", f"n_{names[-1]}")


def stratified_split(
    df: DataFrame, label: Sequence[str], item: str, holdout: Sequence[float], names: Sequence[str], seed: int = SEED
) -> DataFrame:
    """Add ``split`` with exact part sizes per class; ``label=[]`` splits without strata.

    Class counts give the sizes, the sizes give one hash cut per class and part, and
    rows are compared with the cuts: no class is sorted and wide rows are not
    shuffled. ``item`` must be unique within its class.
    """
    label = list(label)
    rows = df.withColumn("_h", hash32(F.col(item), seed=seed))
    if not label:
        # Always 1, but not a constant to the optimizer, which would turn the joins below into cross joins.
        rows = rows.withColumn("_all", F.when(F.col("_h") >= 0, 1))
    keys = label or ["_all"]
    sizes = split_sizes(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, holdout, names)
    upto = F.lit(0).cast("bigint")
    ends = []
    for position, name in enumerate(names[:-1]):
        upto = upto + F.col(f"n_{name}")
        ends.append(F.struct(F.lit(position).alias("_part"), upto.alias("_end")))
    limits = sizes.select(*keys, F.inline(F.array(*ends)))
    cuts = cut_points(rows, keys, ["_h", item], hash_bucket(F.col("_h")), limits, "_end")
    # A part of size 0 at the start has no cut; parts that end with the class reach every row.
    table = null_safe_join(limits, cuts.drop("_end"), [*keys, "_part"], "left").groupBy(*keys).agg(*[
        F.max(F.when(F.col("_part") == p, F.struct("_end", "cut"))).alias(f"_c{p}") for p in range(len(names) - 1)
    ])
    joined = null_safe_join(rows, settle(table, "cuts"), keys)
    split = F
    for position, name in enumerate(names[:-1]):
        end, cut = F.col(f"_c{position}._end"), F.col(f"_c{position}.cut")
        split = split.when((end > 0) & (F.struct("_h", item) <= cut), F.lit(name))
    extra = [] if label else ["_all"]
    return joined.withColumn("split", split.otherwise(F.lit(names[-1]))).drop(
        "_h", *extra, *[f"_c{p}" for p in range(len(names) - 1)])


def hash_split(
    df: DataFrame, item: str, fractions: Sequence[float], names: Sequence[str], seed: int = SEED
) -> DataFrame:
    """Approximate part sizes without any shuffle: a row's part depends on its own hash."""
    u = uniform(F.col(item), seed=seed)
    split, end = F, 0.0
    for fraction, name in zip(fractions[:-1], names[:-1]):
        end += fraction
        split = split.when(u < end, F.lit(name))
    return df.withColumn("split", split.otherwise(F.lit(names[-1])))


def predefined_split(df: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """Rows of a stored split; ``None`` or ``all`` keeps everything."""
    return df if split in (None, "all") else df.where(F.col(column) == split)
