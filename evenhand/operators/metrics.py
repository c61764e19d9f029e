"""Classification metrics from confusion cells.

Rows are read once and reduced to cells ``(by..., true_class, pred_class, n)``.
Accuracy, precision, recall, F1, their averages, the bootstrap and the overall
margin are all functions of the cells, whose number does not grow with the data.
Classes are compared by name, never by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.schemas import OVERALL

TRUE, PRED = "true_class", "pred_class"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- cells -------------------------------------------------------------------

def confusion_cells(df: DataFrame, by: Sequence[str], truth: str = TRUE, pred: str = PRED) -> DataFrame:
    """(by, true_class, pred_class, n); rows without a true class are left out."""
    return (
        df.where(F.col(truth).isNotNull())
        .groupBy(*by, F.col(truth).alias(TRUE), F.col(pred).alias(PRED))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_overall(
    cells: DataFrame, stratum: str, sums: Sequence[str], strata: Sequence[str] | None = None
) -> DataFrame:
    """Add the margin over all strata to a table of additive cells.

    The margin counts every row, also those whose stratum is NULL or not listed;
    such rows give no stratum of their own.
    """
    keys = [c for c in cells.columns if c not in sums]
    rest = [k for k in keys if k != stratum]
    added = cells.groupingSets([keys, rest], *keys).agg(
        *[F.sum(s).alias(s) for s in sums], F.grouping(stratum).alias("_margin")
    )
    listed = F.col(stratum).isNotNull() if strata is None else F.col(stratum).isin(list(strata))
    return (
        added.where((F.col("_margin") == 1) | listed)
        .withColumn(stratum, F.when(F.col("_margin") == 1, F.lit(OVERALL)).otherwise(F.col(stratum)))
        .drop("_margin")
    )


def dense_cells(cells: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Cells over all label pairs, zeros included; labels outside the list are dropped."""
    frame = (
        cells.select(*by).distinct()
        .withColumn(TRUE, F.explode(literal_array(labels)))
        .withColumn(PRED, F.explode(literal_array(labels)))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    kept = cells.where(F.col(TRUE).isin(list(labels)) & F.col(PRED).isin(list(labels)))
    return frame.unionByName(kept.select(*by, TRUE, PRED, "n")).groupBy(*by, TRUE, PRED).agg(F.sum("n").alias("n"))


# --- per class and averages --------------------------------------------------

def class_scores(cells: DataFrame, by: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """(by, class, support, predicted, tp, precision, recall, f1, group_n, group_correct).

    ``labels=None`` covers the classes seen in truth or prediction; a list covers
    exactly these, absent ones with zeros. A prediction outside the list still
    costs recall.
    """
    hit = F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col(TRUE).alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.cast("bigint").alias("tp")),
        F.struct(F.col(PRED).alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    counts = ["support", "predicted", "tp"]
    totals = cells.select(*by, F.inline(roles)).groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in counts])
    # One entry per class: a group's whole report fits in one row, also if no listed class occurs.
    entries = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", F.struct(*counts).alias("c"))))
    groups = totals.groupBy(*by).agg(
        F.map_from_entries(entries).alias("_m"), F.sum("support").alias("group_n"), F.sum("tp").alias("group_correct"))
    names = F.map_keys("_m") if labels is None else literal_array(labels)
    listed = groups.withColumn("class", F.explode(names))
    entry = F.try_element_at("_m", F.col("class"))
    totals = listed.select(
        *by, "class", *[F.coalesce(entry[c], zero).alias(c) for c in counts], "group_n", "group_correct")
    return totals.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")),
        "recall": ratio(F.col("tp"), F.col("support")),
        "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
    })


def accuracy(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, correct, accuracy)."""
    totals = cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)).cast("bigint").alias("correct"),
    )
    return totals.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def average_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, correct, accuracy, macro and weighted averages, balanced accuracy) from :func:`class_scores`.

    ``n`` counts all rows of the group, also those of unlisted classes.
    """
    present = F.col("support") > 0
    averages = scores.groupBy(*by).agg(
        F.max("group_n").alias("n"),
        F.max("group_correct").alias("correct"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
    )
    return averages.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def stratified_metrics(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    stratum: str = "stratum",
    labels: Sequence[str] | None = None,
    strata: Sequence[str] | None = None,
    truth: str = TRUE,
    pred: str = PRED,
) -> DataFrame:
    """Averages per (by, stratum) and overall, from one pass over the rows."""
    keys = [*by, stratum]
    cells = with_overall(confusion_cells(df, keys, truth, pred), stratum, ["n"], strata)
    return average_scores(class_scores(cells, keys, labels), keys)


def pivot_grid(
    df: DataFrame, row: str, column: str, value: str, columns: Sequence[str],
    rows: Sequence[str] | None = None, fill: float | None = None,
) -> DataFrame:
    """One row per ``row`` and one column per listed value; listed rows without data give NULLs."""
    grid = df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))
    if rows is not None:
        wanted = df.sparkSession.range(1).select(F.explode(literal_array(rows)).alias(row))
        grid = wanted.join(grid, row, "left")
    return grid if fill is None else grid.fillna(fill, list(columns))


def wide_class_scores(scores: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Per-class F1 and recall as columns ``f1_<class>``, ``recall_<class>``."""
    columns = [
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{m}_{c}") for m in ("f1", "recall") for c in labels
    ]
    return scores.groupBy(*by).agg(*columns)


def best_model(
    metrics: DataFrame, names: Sequence[str], order: Mapping[str, int], model: str = "model"
) -> DataFrame:
    """(metric, model, value): largest value per metric, the first listed model wins ties."""
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    long = metrics.select(
        F.col(model).alias("model"), F.element_at(rank, F.col(model)).alias("_order"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])),
    ).where(F.col("value").isNotNull())
    best = F.max_by(F.struct("model", "value"), F.struct(F.col("value"), -F.col("_order")))
    return long.groupBy("metric").agg(best.alias("b")).select("metric", "b.model", "b.value")
