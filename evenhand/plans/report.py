"""Combined report of several models: averages, per-class scores, confidence, best models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evenhand.operators import audit, metrics, roc
from evenhand.session import reliable_checkpoint

# The metrics for which a best model is named.
BEST_BY = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "macro_auc"]


def combined_report(rows: DataFrame, classes: Sequence[str], confidence: str = "score", model: str = "model") -> DataFrame:
    """One row per model: averages, macro AUC, confidence, and ``f1_<class>`` and ``auc_<class>`` of every class.

    ``rows`` has (model, true_class, pred_class, probs in the order of ``classes``,
    confidence). It is written once, so that scoring runs once; every table below
    reads its own columns of it.
    """
    by = [model]
    scored = reliable_checkpoint(rows, "scored")
    scores = metrics.class_scores(metrics.confusion_cells(scored, by), by, classes)
    auc = reliable_checkpoint(roc.auc_by_class(roc.score_cells(scored, by, classes), by), "auc")
    each = auc.groupBy(*by).agg(*[F.max(F.when(F.col("class") == c, F.col("auc"))).alias(f"auc_{c}") for c in classes])
    right = F.col(metrics.TRUE) == F.col(metrics.PRED)
    f1 = metrics.wide_class_scores(scores, by, classes).select(model, *[f"f1_{c}" for c in classes])
    parts = [
        metrics.average_scores(scores, by).drop("correct"), f1, roc.macro_auc(auc, by), each,
        audit.confidence_by_outcome(scored, by, confidence, right).drop("n"),
    ]
    return reduce(lambda a, b: a.join(b, by), parts)


def best_models(report: DataFrame, by: Sequence[str] = BEST_BY, model: str = "model") -> DataFrame:
    """(metric, model, value): the best model of each metric, ties to the smaller name."""
    long = report.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(model).alias("model"), F.col(m).cast("double").alias("value")) for m in by])))
    top = long.groupBy("metric").agg(F.max("value").alias("value"))
    return long.join(top, ["metric", "value"]).groupBy("metric").agg(F.min("model").alias("model"), F.first("value").alias("value"))
