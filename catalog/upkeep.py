"""State that is kept between runs: stored cells and sketches, bucketed tables, counted writes, replayed batches."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from catalog import inputs as I
from catalog.evaluation import AVERAGE_SQL, AVERAGES, COUNTS, KEYS, MCNEMAR_SQL
from catalog.registry import query
from evenhand.operators import audit, colocated, gate, incremental, inference, metrics, sketches
from evenhand.session import new_work_path, reliable_checkpoint
from evenhand.sources import sinks
from evenhand.streaming.exactly_once import read_batches, run_batches
from evenhand.streaming.rowwise import read_record_stream


@query("incremental_metrics", I.CELLS_SQL + AVERAGE_SQL, ints="n correct", doubles=AVERAGES)
def incremental_metrics(spark, sf_dir):
    """Metrics from stored cells: three appends, of which each run reads the new files only, and a run without any."""
    rows = reliable_checkpoint(I.order_scores(spark, sf_dir).select(*KEYS, "item_id", "true_class", "pred_class"), "scores")
    folder, store = new_work_path(spark, "appended"), new_work_path(spark, "cells")

    def cells(df, files):
        return metrics.confusion_cells(df, [*files, *KEYS])

    def read(paths):
        return spark.read.schema(rows.schema).parquet(*paths)

    part = F.pmod(F.crc32(F.col("item_id").cast("binary")), F.lit(3))
    for i in (0, 1, 2):
        sinks.write_table(rows.where(part == i), folder, mode="append")
        incremental.update_cells(spark, folder, store, read, cells)
    incremental.update_cells(spark, folder, store, read, cells)
    known = metrics.with_overall(incremental.current_cells(spark, folder, store, ["n"]), "stratum", ["n"], I.STRATA)
    return metrics.average_scores(metrics.class_scores(known, KEYS, I.ORDER_CLASSES), KEYS)


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("sketch_quantiles", f"""
SELECT o_orderstatus, prob, count(*) AS n, true AS within
FROM orders, (SELECT unnest({PROBS}) AS prob) GROUP BY o_orderstatus, prob""", ints="n", doubles="prob")
def sketch_quantiles(spark, sf_dir):
    """Quantiles from sketches of three parts, merged; each has its rank within twice the stated error."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = sketches.value_sketches(
        orders.withColumn("part", F.col("o_orderkey") % 3), ["part", "o_orderstatus"], "o_totalprice")
    kept = reliable_checkpoint(parts, "sketches")
    found = sketches.sketched_quantiles(sketches.merged_sketches(kept, ["o_orderstatus"]), ["o_orderstatus"], PROBS)
    value = F.col("o_totalprice").cast("double")
    ranks = orders.join(found, "o_orderstatus").groupBy("o_orderstatus", "prob", "n").agg(
        F.avg((value < F.col("quantile")).cast("double")).alias("below"),
        F.avg((value <= F.col("quantile")).cast("double")).alias("upto"))
    error = F.greatest(F.col("below") - F.col("prob"), F.col("prob") - F.col("upto"), F.lit(0.0))
    return ranks.select("o_orderstatus", "prob", "n", (error <= 2 * sketches.rank_error()).alias("within"))


@query("observed_accounting", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE text IS NULL) AS no_text,
       count(*) FILTER (WHERE n_chars >= 500) AS n_kept, count(*) FILTER (WHERE n_chars >= 500) AS written FROM documents
""", ints="n_rows short no_text n_kept written")
def observed_accounting(spark, sf_dir):
    """Rows before and after a filter, counted by the write of the filtered rows itself."""
    path = new_work_path(spark, "observed")
    counts = audit.write_with_accounting(
        I.table(spark, sf_dir, "documents"), path, {"short": F.col("n_chars") < 500, "no_text": F.col("text").isNull()},
        F.col("n_chars") >= 500)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written"))
    return written.select(*[F.lit(v).alias(k) for k, v in counts.items()], "written")


@query("colocated_pairs", MCNEMAR_SQL + " SELECT * FROM counts", ints=COUNTS)
def colocated_pairs(spark, sf_dir):
    """Truth and predictions in buckets of the item: joined and paired without a shuffle on it."""
    paired = colocated_predictions(spark, sf_dir)
    others = [m for m in I.MODELS if m != "orig"]
    return inference.mcnemar_counts(paired, "orig", others, "stratum", I.STRATA).select(
        "baseline", "other", "stratum", *COUNTS.split())


def colocated_predictions(spark, sf_dir, buckets: int = 8):
    """One row per item with a boolean for each model, from two tables in ``buckets`` buckets or more, as their rows need."""
    items = I.order_items(spark, sf_dir)
    buckets = colocated.bucket_count(len(I.MODELS) * items.count(), buckets)
    run = uuid.uuid4().hex
    truth = colocated.write_colocated(items.select("item_id", "true_class", "stratum"), f"truth_{run}", "item_id", buckets)
    predictions = colocated.write_colocated(
        I.order_predictions(items).select("model", "item_id", "pred_class"), f"predictions_{run}", "item_id", buckets)
    return inference.paired_correct(predictions.join(truth, "item_id"), "item_id", list(I.MODELS), ["stratum"])


@query("replayed_batches", I.DOCUMENTS_SQL + " SELECT image_id, reason, word_count FROM gated", ints="word_count")
def replayed_batches(spark, sf_dir):
    """A stream that fails between the write of a batch and its commit, and is started again: nothing twice."""
    schema = I.table(spark, sf_dir, "documents").schema
    stream = read_record_stream(spark, f"{sf_dir}/documents*.parquet", schema, "parquet")
    regions = F.array(*[F.lit(r) for r in I.REGIONS])
    records = stream.select(
        F.col("doc_id").alias("image_id"), F.col("text").alias("teacher_reasoning"), F.col("lang").alias("predicted_class"),
        F.get(regions, (F.col("doc_id") % 6).cast("int")).alias("gradcam_spatial_region"))
    path, checkpoint = new_work_path(spark, "replayed"), new_work_path(spark, "replayed-checkpoint")

    def step(batch):
        return gate.gate(gate.run_checks(batch, I.LEXICON)).select("image_id", "reason", "word_count")

    def fail(number: int) -> None:
        raise RuntimeError(f"stopped after batch {number} was written")

    try:
        run_batches(records, step, path, checkpoint, after_write=fail)
    except StreamingQueryException:
        run_batches(records, step, path, checkpoint)
    return read_batches(spark, path, T.StructType().add("image_id", "long").add("reason", "string").add("word_count", "integer"))
