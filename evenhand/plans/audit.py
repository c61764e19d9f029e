"""Stratified audit job: three tables in, all result tables out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenhand.functions.labels import stem
from evenhand.operators import audit, inference, joins, metrics, roc
from evenhand.operators.ranking import null_safe_join
from evenhand.schemas import EVAL_CLASSES, MODEL_CLASSES, OVERALL, STRATA, nan_to_null, require_columns
from evenhand.session import reliable_checkpoint
from evenhand.sources import sinks, tables

KEYS = ["model", "stratum"]


@dataclass(frozen=True)
class AuditTables:
    metrics: DataFrame
    grid: DataFrame
    intervals: DataFrame
    mcnemar: DataFrame
    class_composition: DataFrame
    source_composition: DataFrame | None
    sensitivity_metrics: DataFrame
    sensitivity_intervals: DataFrame

    def items(self) -> dict[str, DataFrame]:
        """Result tables by name, those that were made."""
        names = ["metrics", "grid", "intervals", "mcnemar", "class_composition", "source_composition",
                 "sensitivity_metrics", "sensitivity_intervals"]
        return {n: getattr(self, n) for n in names if getattr(self, n) is not None}


def stratified_audit(
    strata: DataFrame, truth: DataFrame, predictions: DataFrame,
    models: Sequence[str], baseline: str, classes: Sequence[str], prob_classes: Sequence[str],
    stratum_order: Sequence[str] = STRATA, thresholds: Sequence[float] = (0.6, 0.8),
    exclude_flag: str | None = None, metadata: DataFrame | None = None, site_columns: Sequence[str] = joins.SITE_COLUMNS,
    draws: int = 1000, exact_below: int = 25,
) -> AuditTables:
    """Metrics, intervals, paired tests and confounder audits.

    Inputs: strata (image_id, stratum, confidence[, flag]), truth (image_id,
    true_class), predictions (model, image_id, pred_class, probs in the order of
    ``prob_classes``). The first threshold selects the main subset, all of them the
    sensitivity tables. The joined table is written once; confusion cells,
    distinct-score cells and paired outcomes each read it with their own columns. The
    sensitivity metrics have a row for every threshold, model and stratum: empty ones
    have n = 0 and NULL for the rest.
    """
    low = min(thresholds)
    merged = reliable_checkpoint(
        joins.build_merged(strata, truth, predictions, "image_id", low, "confidence", exclude_flag), "merged")
    main = merged if thresholds[0] == low else merged.where(F.col("confidence") >= thresholds[0])
    cells = reliable_checkpoint(metrics.with_overall(
        metrics.confusion_cells(main, KEYS), "stratum", ["n"], stratum_order), "cells")
    scores = metrics.class_scores(cells, KEYS, classes)
    averages = metrics.average_scores(scores, KEYS)
    per_class = metrics.wide_class_scores(scores, KEYS, classes)
    auc = roc.stratified_auc(main, ["model"], "stratum", prob_classes, stratum_order)
    auc = roc.macro_auc(auc.where(F.col("class").isin(list(classes))), KEYS)
    table = null_safe_join(null_safe_join(averages, per_class, KEYS), auc, KEYS, "left")

    paired = inference.paired_correct(main, "image_id", models, ["stratum"])
    counts = inference.mcnemar_counts(paired, baseline, [m for m in models if m != baseline], "stratum", stratum_order)
    one_model = main.where(F.col("model") == models[0])
    site = None
    if metadata is not None:
        column = joins.detect_column(metadata, site_columns, required=False)
        if column is not None:
            sites = joins.add_metadata(one_model.select("image_id", "stratum"), metadata, "image_id", [column])
            site = audit.source_composition(sites, "stratum", column, stratum_order)
    strict = inference.sensitivity_cells(merged, "confidence", thresholds, ["model"], "stratum", stratum_order)
    strict_keys = ["threshold", *KEYS]
    strict_scores = metrics.class_scores(strict, strict_keys, classes)
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    nested = merged.withColumn("threshold", F.explode(F.filter(steps, lambda t: F.col("confidence") >= t)))
    strict_auc = roc.stratified_auc(nested, ["threshold", "model"], "stratum", prob_classes, stratum_order)
    strict_auc = roc.macro_auc(strict_auc.where(F.col("class").isin(list(classes))), strict_keys)
    strict_table = null_safe_join(
        null_safe_join(metrics.average_scores(strict_scores, strict_keys),
                       metrics.wide_class_scores(strict_scores, strict_keys, classes), strict_keys),
        strict_auc, strict_keys, "left")
    listed = {"threshold": sorted(map(float, thresholds)), "model": models, "stratum": [*stratum_order, OVERALL]}
    frame = merged.sparkSession.range(1).select()
    for name, values in listed.items():
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return AuditTables(
        metrics=table,
        grid=metrics.pivot_grid(table, "model", "stratum", "macro_f1", [*stratum_order, "Overall"], rows=models),
        intervals=inference.bootstrap_macro_f1(cells, KEYS, classes, draws, strata=stratum_order),
        mcnemar=inference.mcnemar_test(counts, exact_below),
        class_composition=audit.class_composition(one_model, "stratum", "true_class", classes, stratum_order),
        source_composition=site,
        sensitivity_metrics=null_safe_join(frame, strict_table, strict_keys, "left").fillna(0, ["n"]),
        sensitivity_intervals=inference.bootstrap_macro_f1(strict, strict_keys, classes, draws),
    )


def read_truth(spark: SparkSession, path: str, classes: Sequence[str], include_unknown: bool = False) -> DataFrame:
    """(image_id, true_class) of a one-hot CSV; the id column is found by name."""
    names = tables.csv_header(spark, path)
    item = next((c for c in joins.TRUTH_ID_COLUMNS if c in names), names[0])
    unknown = "UNK" if "UNK" in names and "UNK" not in classes else None
    schema = T.StructType().add(item, "string")
    for c in [*classes, *([unknown] if unknown else [])]:
        schema = schema.add(c, "double")
    rows = tables.read_csv(spark, path, schema, [item, *classes])
    return joins.label_ground_truth(rows, classes, item, include_unknown=include_unknown)


def read_strata(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, stratum, confidence, flag) of a stratum CSV; the id may come from the file name."""
    names = tables.csv_header(spark, path)
    columns = [("image_id", "string"), ("file", "string"), ("mst_name", "string"), ("confidence_val", "double"),
               ("has_vignette", "boolean")]
    schema = T.StructType()
    for name, kind in columns:
        schema = schema.add(name, kind)
    required = ["mst_name", "confidence_val", "image_id" if "image_id" in names else "file"]
    rows = tables.read_csv(spark, path, schema, required)
    return rows.select(
        F.coalesce("image_id", stem(F.col("file"))).alias("image_id"), F.col("mst_name").alias("stratum"),
        F.col("confidence_val").alias("confidence"), F.col("has_vignette").alias("flag"))


def audit_from_files(
    spark: SparkSession, truth_csv: str, strata_csv: str, prediction_folder: str, out: str,
    models: Sequence[str], baseline: str, classes: Sequence[str] = EVAL_CLASSES,
    model_classes: Sequence[str] = MODEL_CLASSES, metadata_csv: str | None = None, include_unknown: bool = False,
    without_flagged: bool = False, thresholds: Sequence[float] = (0.6, 0.8), draws: int = 1000,
) -> AuditTables:
    """The audit from CSV files to one CSV folder per result table below ``out``."""
    listed = [*classes, "UNK"] if include_unknown else list(classes)
    truth = read_truth(spark, truth_csv, classes, include_unknown)
    raw = tables.read_predictions(spark, prediction_folder, model_classes, models)
    predictions = joins.long_predictions(raw, model_classes)
    metadata = None
    if metadata_csv is not None:
        loose = nan_to_null(spark.read.option("header", True).csv(metadata_csv))
        item = joins.detect_column(loose, ["image", "isic_id", "image_id"], required=False) or loose.columns[0]
        metadata = loose.withColumnRenamed(item, "image_id")
    job = stratified_audit(
        require_columns(read_strata(spark, strata_csv), ["image_id"]), truth, predictions, models, baseline, listed,
        model_classes, thresholds=thresholds, exclude_flag="flag" if without_flagged else None, metadata=metadata,
        draws=draws)
    for name, table in job.items().items():
        sinks.write_csv(table, f"{out.rstrip('/')}/{name}")
    return job
