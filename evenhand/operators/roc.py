"""Exact one-vs-rest AUC and ROC points at any data size.

Rows are reduced to distinct-score cells ``(by..., class, score, pos, neg)``.
The number of negatives below a score is a prefix sum over the cells; it is
taken in three levels over order-preserving digits of the score, so that no task
ever sorts a whole class. For the area no join back is needed: the pair count
``sum(pos * (neg_below + neg / 2))`` is the sum of the three levels' own counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.radix import digits
from evenhand.operators.metrics import literal_array, with_overall
from evenhand.operators.ranking import null_safe_join


def score_cells(
    df: DataFrame, by: Sequence[str], labels: Sequence[str], probs: str | Column = "probs", truth: str = "true_class"
) -> DataFrame:
    """(by, class, score, pos, neg) for every label; ``probs`` is an array in the order of ``labels``."""
    values = F.col(probs) if isinstance(probs, str) else probs
    scored = F.explode(F.arrays_zip(literal_array(labels).alias("class"), values.alias("score")))
    rows = (
        df.where(F.col(truth).isNotNull())
        .select(*by, F.col(truth).alias("_t"), scored.alias("_s"))
        .select(*by, F.col("_s.class").alias("class"), F.col("_s.score").cast("double").alias("score"),
                (F.col("_s.class") == F.col("_t")).cast("int").alias("_p"))
        .where(F.col("score").isNotNull() & ~F.isnan("score"))
    )
    return rows.groupBy(*by, "class", "score").agg(
        F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg")
    )


def _below(column: str, keys: Sequence[str], order: str) -> Column:
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0)).cast("double")


def auc_by_class(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, class, pos, neg, auc); ties count half. ``auc`` is NULL if either side is empty."""
    coarse, fine = digits(F.col("score"))
    keys = [*by, "class"]
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")

    def collapse(df: DataFrame, to: Sequence[str]) -> DataFrame:
        return df.groupBy(*to).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_u").alias("_u"))

    low = cells.withColumns({"_c": coarse, "_f": fine})
    low = low.withColumn("_u", pos * (_below("neg", [*keys, "_c", "_f"], "score") + neg / 2))
    mid = collapse(low, [*keys, "_c", "_f"])
    mid = mid.withColumn("_u", F.col("_u") + pos * _below("neg", [*keys, "_c"], "_f"))
    top = collapse(mid, [*keys, "_c"])
    top = top.withColumn("_u", F.col("_u") + pos * _below("neg", keys, "_c"))
    return collapse(top, keys).select(
        *keys, "pos", "neg",
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("_u") / (pos * neg)).alias("auc"),
    )


def macro_auc(class_auc: DataFrame, by: Sequence[str], on_undefined: str = "skip") -> DataFrame:
    """(by, macro_auc) over the classes that have positives.

    ``on_undefined="skip"`` leaves out classes without positives and is NULL if
    none is left; ``"zero"`` gives 0.0 as soon as one class is undefined.
    """
    if on_undefined not in ("skip", "zero"):
        raise ValueError(f"on_undefined must be skip or zero, not {on_undefined!r}")
    mean = F.avg("auc")
    if on_undefined == "zero":
        mean = F.when(F.count("auc") == F.count(F.lit(1)), mean).otherwise(0.0)
    return class_auc.groupBy(*by).agg(mean.alias("macro_auc"))


def stratified_auc(
    df: DataFrame, by: Sequence[str], stratum: str, labels: Sequence[str],
    strata: Sequence[str] | None = None, probs: str | Column = "probs", truth: str = "true_class",
) -> DataFrame:
    """Per-class AUC per (by, stratum) and overall; the margin is summed on the cells."""
    cells = score_cells(df, [*by, stratum], labels, probs, truth)
    return auc_by_class(with_overall(cells, stratum, ["pos", "neg"], strata), [*by, stratum])


def roc_points(cells: DataFrame, by: Sequence[str], drop_collinear: bool = False) -> DataFrame:
    """(by, class, threshold, tpr, fpr), one point per distinct score, highest first.

    The (0, 0) start has threshold NULL. Classes without positives or without
    negatives have no curve. ``drop_collinear`` leaves out points where the curve
    does not turn.
    """
    keys = [*by, "class"]
    coarse, fine = digits(F.col("score"))
    low = cells.withColumns({"_c": coarse, "_f": fine})
    first = F.max_by(F.struct("pos", "neg"), F.col("score"))

    # Counts of the buckets above, attached from the top level downwards.
    mid = low.groupBy(*keys, "_c", "_f").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), first.alias("_head"))
    top = mid.groupBy(*keys, "_c").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max_by("_head", "_f").alias("_head"))

    def above(df: DataFrame, within: Sequence[str], order: str) -> dict[str, Column]:
        w = Window.partitionBy(*within).orderBy(F.desc(order))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        columns = {f"_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in ("pos", "neg")}
        columns["_next"] = F.lead("_head" if "_head" in df.columns else F.struct("pos", "neg")).over(w)
        return columns

    whole = Window.partitionBy(*keys)
    top = top.withColumns({**above(top, keys, "_c"),
                           "_P": F.sum("pos").over(whole), "_N": F.sum("neg").over(whole)})
    offsets = top.select(*keys, "_c", *[F.col(c).alias(f"{c}1") for c in ("_pos", "_neg", "_next")], "_P", "_N")
    mid = mid.withColumns(above(mid, [*keys, "_c"], "_f"))
    mid = null_safe_join(mid, offsets, [*keys, "_c"]).select(
        *keys, "_c", "_f",
        (F.col("_pos") + F.col("_pos1")).alias("_pos2"), (F.col("_neg") + F.col("_neg1")).alias("_neg2"),
        F.coalesce("_next", "_next1").alias("_next2"), "_P", "_N",
    )
    low = low.withColumns(above(low, [*keys, "_c", "_f"], "score"))
    points = null_safe_join(low, mid, [*keys, "_c", "_f"]).where((F.col("_P") > 0) & (F.col("_N") > 0))
    points = points.withColumns({
        "_tp": F.col("_pos2") + F.col("_pos") + F.col("pos"),
        "_fp": F.col("_neg2") + F.col("_neg") + F.col("neg"),
        "_ahead": F.coalesce("_next", "_next2"),
    })
    if drop_collinear:
        is_first = (F.col("_tp") == F.col("pos")) & (F.col("_fp") == F.col("neg"))
        turns = (F.col("_ahead.pos") != F.col("pos")) | (F.col("_ahead.neg") != F.col("neg"))
        points = points.where(is_first | F.col("_ahead").isNull() | turns)
    curve = points.select(
        *keys, F.col("score").alias("threshold"),
        (F.col("_tp") / F.col("_P")).alias("tpr"), (F.col("_fp") / F.col("_N")).alias("fpr"),
    )
    start = top.where((F.col("_P") > 0) & (F.col("_N") > 0)).select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    ).distinct()
    return start.unionByName(curve)
