"""Sources, sinks, resumable runs and batch scoring: tables written and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F, types as T

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions import arrays as A
from evenhand.operators import audit, gate, metrics, sampling, scoring
from evenhand.session import new_work_path
from evenhand.sources import images, json_pieces, sinks, tables
from evenhand.streaming.rowwise import read_record_stream, run_until_done
from catalog.sampling import SPLIT_SQL


@query("prediction_files", I.ORDERS_SQL + """
SELECT model, item_id AS image_id, CASE pred_class WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pred_idx,
       p_F AS prob_F, p_O AS prob_O, p_P AS prob_P FROM scores""", ints="pred_idx", doubles="prob_F prob_O prob_P")
def prediction_files(spark, sf_dir):
    """One CSV per model, two of them with another column order, read by name with the model from the file name."""
    rows = I.order_scores(spark, sf_dir)
    classes = F.array(*[F.lit(c) for c in I.ORDER_CLASSES])
    wide = rows.select(
        "model", F.col("item_id").alias("image_id"), (F.array_position(classes, F.col("pred_class")) - 1).alias("pred_idx"),
        *[F.get("probs", F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(I.ORDER_CLASSES)])
    folder = new_work_path(spark, "predictions")
    turned = F.col("model").isin("orig", "lambda07")
    sinks.write_predictions(wide.where(~turned), folder)
    sinks.write_predictions(wide.where(turned).select(*reversed(wide.columns)), folder, mode="append")
    return tables.read_predictions(spark, folder, I.ORDER_CLASSES)


@query("csv_with_missing_values", """
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN len(html)::DOUBLE END AS size, NULL AS site FROM pages""", doubles="size")
def csv_with_missing_values(spark, sf_dir):
    """CSV by column name: nan and empty become NULL, an optional column is filled."""
    size = F.when(F.col("page_id") % 10 == 0, F.lit(float("nan"))).when(
        F.col("page_id") % 5 != 0, F.length("html").cast("double"))
    rows = I.table(spark, sf_dir, "pages").select(F.lit("x").alias("unused"), size.alias("size"), "page_id")
    path = new_work_path(spark, "csv")
    sinks.write_csv(rows, path)
    schema = T.StructType().add("page_id", "long").add("size", "double").add("site", "string")
    return tables.read_csv(spark, path, schema, ["page_id", "size"])


@query("json_lines_by_split", SPLIT_SQL + """
SELECT p.doc_id, split, md5(text) AS text, lang FROM parts p JOIN documents d USING (doc_id)""")
def json_lines_by_split(spark, sf_dir):
    """JSON lines, one folder per split, read back with an explicit schema."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    parts = sampling.stratified_split(documents, ["lang"], "doc_id", [0.15, 0.333], ["train", "validation", "test"])
    path = new_work_path(spark, "splits")
    sinks.write_json_lines(parts, path, ["split"])
    schema = T.StructType().add("doc_id", "long").add("lang", "string").add("text", "string").add("split", "string")
    return tables.read_json_lines(spark, path, schema).select("doc_id", "split", F.md5("text").alias("text"), "lang")


def _array_files(spark, sf_dir, columns=("doc_id", "source", "n_chars")):
    """One file with a JSON array per language and thousand of document numbers."""
    rows = I.table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / 1000))
    arrays = rows.groupBy("lang", "part").agg(  # a thousand rows at most
        F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("value"))
    path = new_work_path(spark, "arrays")
    arrays.select("lang", "value").write.partitionBy("lang").option("maxRecordsPerFile", 1).text(path)
    return path


@query("json_array_files", "SELECT doc_id, source, n_chars FROM documents", ints="n_chars")
def json_array_files(spark, sf_dir):
    """Files that hold one JSON array each, read with an explicit schema."""
    schema = T.StructType().add("doc_id", "long").add("source", "string").add("n_chars", "long")
    return tables.read_json_array(spark, f"{_array_files(spark, sf_dir)}/lang=*", schema)


@query("json_array_split", "SELECT doc_id, md5(text) AS text, source, n_chars FROM documents", ints="n_chars")
def json_array_split(spark, sf_dir):
    """The same arrays with whole texts, each file cut into byte ranges that are read by tasks of their own."""
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("source", "string").add("n_chars", "long")
    folder = _array_files(spark, sf_dir, ("doc_id", "text", "source", "n_chars"))
    read = json_pieces.read_json_pieces(spark, f"{folder}/lang=*", schema, split_bytes=64 << 10, piece_bytes=16 << 10)
    return read.withColumn("text", F.md5("text"))


@query("file_listing", """
SELECT lang, count(DISTINCT doc_id // 1000) AS n, true AS filled FROM documents GROUP BY lang""", ints="n")
def file_listing(spark, sf_dir):
    """Files below a folder with their path and length; contents are not read."""
    files = images.list_images(spark, _array_files(spark, sf_dir), pattern="part-*.txt")
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1)
    return files.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("length") > 2).alias("filled"))


@query("missing_optional_input", "SELECT doc_id, CAST(NULL AS VARCHAR) AS lang FROM documents")
def missing_optional_input(spark, sf_dir):
    """An optional input that is not there is an empty table of the schema, joined as usual."""
    schema = T.StructType().add("doc_id", "long").add("lang", "string")
    nothing = tables.read_json_lines(spark, new_work_path(spark, "absent"), schema, optional=True)
    return I.table(spark, sf_dir, "documents").select("doc_id").join(nothing, "doc_id", "left")


@query("kept_and_filtered_sink", f"WITH{I.ITEMS_SQL}" + """
SELECT confidence >= 0.6 AS kept, stratum, count(*) AS n, sum(confidence) AS total FROM items GROUP BY ALL""", ints="n", doubles="total")
def kept_and_filtered_sink(spark, sf_dir):
    """Both sides of a predicate written in one pass."""
    rows = I.embedding_items(spark, sf_dir).drop("embedding")
    path = new_work_path(spark, "kept")
    sinks.write_kept_and_filtered(rows, F.col("confidence") >= 0.6, path)
    return spark.read.schema(rows.schema.add("kept", "boolean")).parquet(path).groupBy("kept", "stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"))


@query("array_sink", I.ARRAYS_SQL + """
SELECT label, count(DISTINCT item_id) AS n, sum(v) AS total, count(*) AS cells FROM cells GROUP BY label""", ints="n cells", doubles="total")
def array_sink(spark, sf_dir):
    """Dense arrays as array columns, partitioned by label."""
    path = new_work_path(spark, "arrays")
    sinks.write_table(I.arrays_8x8(spark, sf_dir), path, ["label"])
    back = spark.read.parquet(path)
    return back.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(A.total(F.col("cells"))).alias("total"), F.sum(F.size("cells")).alias("cells"))


@query("json_report", I.DOCUMENTS_SQL + """
SELECT label AS class, count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM gated GROUP BY label""", ints="n passed")
def json_report(spark, sf_dir):
    """Report tables as one JSON document, written and parsed back."""
    checked = gate.run_checks(I.document_records(spark, sf_dir), I.LEXICON)
    path = new_work_path(spark, "report")
    sinks.write_report(sinks.report_json({"classes": gate.class_pass_rates(checked)}), path)
    schema = "classes array<struct<class: string, n: bigint, passed: bigint, rate: double>>"
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return parsed.select(F.inline("r.classes")).select("class", "n", "passed")


@query("resumed_batch", I.DOCUMENTS_SQL + " SELECT image_id, reason FROM gated")
def resumed_batch(spark, sf_dir):
    """A run that stopped halfway and is started again: pending rows only, nothing twice."""
    records = I.document_records(spark, sf_dir)
    path = new_work_path(spark, "resume")

    def step(df):
        return gate.gate(gate.run_checks(df, I.LEXICON)).select("image_id", "reason")

    half = F.floor(F.col("image_id") / 2) % 2 == 0
    sinks.resume_batch(records.where(half), path, "image_id", step)
    return sinks.resume_batch(records, path, "image_id", step)


@query("streamed_gate", I.DOCUMENTS_SQL + " SELECT image_id, reason, word_count FROM gated", ints="word_count")
def streamed_gate(spark, sf_dir):
    """The same gate on a file stream with a checkpoint folder."""
    schema = I.table(spark, sf_dir, "documents").schema
    stream = read_record_stream(spark, f"{sf_dir}/documents*.parquet", schema, "parquet")
    regions = F.array(*[F.lit(r) for r in I.REGIONS])
    records = stream.select(
        F.col("doc_id").alias("image_id"), F.col("text").alias("teacher_reasoning"), F.col("lang").alias("predicted_class"),
        F.get(regions, (F.col("doc_id") % 6).cast("int")).alias("gradcam_spatial_region"))

    def step(df):
        return gate.gate(gate.run_checks(df, I.LEXICON)).select("image_id", "reason", "word_count")

    path = new_work_path(spark, "streamed")
    run_until_done(records, step, path, new_work_path(spark, "stream-checkpoint"))
    return spark.read.schema("image_id bigint, reason string, word_count int").parquet(path)


def _scored_in_batches(spark, sf_dir, tags=tuple(I.MODEL_DIMS)):
    items = I.embedding_items(spark, sf_dir)
    # The fitted model: ten classes x 64 numbers, held by the driver as any model is.
    means = scoring.class_means(items, "true_class", "embedding", 64).orderBy("class").collect()
    matrix = np.array([r["mean"] for r in means])
    models = {tag: scoring.nearest_mean_factory(matrix[:, :d]) for tag, d in I.MODEL_DIMS.items() if tag in tags}
    return scoring.batch_scores(
        items, models, "embedding", 64, [r["class"] for r in means], ["item_id", "true_class", "stratum"])


@query("batch_scores", I.VECTORS_SQL + """
SELECT item_id, model, pred_class, score AS confidence FROM scored""", doubles="confidence")
def batch_scores(spark, sf_dir):
    """Several models applied to Arrow batches, the input read once."""
    return _scored_in_batches(spark, sf_dir).select("item_id", "model", "pred_class", "confidence")


@query("model_sweep_accuracy", I.VECTORS_SQL + """,
t AS (SELECT model, stratum, count(*) AS n, count(*) FILTER (WHERE true_class = pred_class) AS k FROM scored GROUP BY ALL),
a AS (SELECT * FROM t UNION ALL SELECT model, 'Overall', sum(n), sum(k) FROM t GROUP BY model)
SELECT model, stratum, n, k::DOUBLE / n AS accuracy FROM a""", ints="n", doubles="accuracy")
def model_sweep_accuracy(spark, sf_dir):
    """Quick accuracy of every scored model per stratum and overall."""
    cells = metrics.confusion_cells(_scored_in_batches(spark, sf_dir), ["model", "stratum"])
    cells = metrics.with_overall(cells, "stratum", ["n"], I.STRATA)
    return metrics.accuracy(cells, ["model", "stratum"]).select("model", "stratum", "n", "accuracy")


@query("scored_summary", I.VECTORS_SQL + """
SELECT pred_class AS class, count(*) AS n, avg(score) AS mean_conf FROM scored WHERE model = 'lambda10' GROUP BY pred_class
""", ints="n", doubles="mean_conf")
def scored_summary(spark, sf_dir):
    """Batch scoring followed by the confidence audit."""
    rows = _scored_in_batches(spark, sf_dir, ("lambda10",))
    return audit.confidence_by_class(rows, ["pred_class"], "confidence").select(
        F.col("pred_class").alias("class"), "n", "mean_conf")
