"""Manifests of external test sets: taxonomy, scale, source and file path per item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from evenhand.functions import labels as L
from evenhand.operators import joins
from evenhand.schemas import require_columns
from evenhand.sources.images import resolve_paths

SUFFIXES = (".jpg", ".png", ".jpeg", "")


def dual_rater_manifest(
    raw: DataFrame, listing: DataFrame, taxonomy: DataFrame, arms: Sequence[str] | None = None,
    raw_label: str = "label", item: str = "md5hash",
) -> DataFrame:
    """(image_id, path, true_class, fitzpatrick_scale, fitzpatrick_centaur, fst_tertile, source, qc_flag, mapping).

    Rows of unmapped labels, of scales outside 1..6 and without a file are dropped;
    all taxonomy arms are made in one pass.
    """
    rows = require_columns(raw, [item, raw_label, "fitzpatrick_scale"]).withColumnRenamed(raw_label, "_raw")
    rows = joins.apply_taxonomy(rows, taxonomy, "_raw", arms)
    none = F.lit(None).cast("string")
    rows = joins.conform(rows, missing={"fitzpatrick_centaur": none, "url": none, "url_alphanum": none, "qc": none})
    scale = L.to_number(F.col("fitzpatrick_scale").cast("string"), 1, 6).cast("int")
    rows = rows.withColumn("_scale", scale).where(F.col("_scale").isNotNull())
    found = resolve_paths(rows, listing, item, SUFFIXES, [("url_alphanum", ("", ".jpg"))]).where(F.col("path").isNotNull())
    return found.select(
        F.col(item).alias("image_id"), "path", F.col("label").alias("true_class"), F.col("_scale").alias("fitzpatrick_scale"),
        L.to_number(F.col("fitzpatrick_centaur").cast("string")).alias("fitzpatrick_centaur"),
        L.map_values(F.col("_scale"), L.SCALE_TO_STRATUM).alias("fst_tertile"),
        L.host_class(F.col("url")).alias("source"), F.col("qc").alias("qc_flag"), F.col("arm").alias("mapping"),
    )


def single_rater_manifest(
    raw: DataFrame, listing: DataFrame, taxonomy: DataFrame, raw_label: str, arms: Sequence[str] | None = None,
    strata: Mapping[int, str] = L.INVERTED_SCALE_TO_STRATUM, default_source: str = "unknown",
) -> DataFrame:
    """(image_id, path, true_class, skin_tone_class, tone_tertile, source, mapping) with the inverted 0..5 scale."""
    item = joins.detect_column(raw, joins.ID_COLUMNS)
    site = joins.detect_column(raw, joins.SOURCE_COLUMNS, required=False)
    source = F.lit(default_source) if site is None else F.coalesce(F.col(site).cast("string"), F.lit("unknown"))
    rows = require_columns(raw, [raw_label, "skin_tone_class"]).select(
        F.col(item).cast("string").alias("image_id"), F.col(raw_label).alias("_raw"), source.alias("source"),
        L.to_number(F.col("skin_tone_class").cast("string"), 0, 5).cast("int").alias("skin_tone_class"))
    rows = joins.apply_taxonomy(rows.where(F.col("skin_tone_class").isNotNull()), taxonomy, "_raw", arms)
    found = resolve_paths(rows, listing, "image_id", (".jpg", ".JPG", ".png", ".jpeg", "")).where(F.col("path").isNotNull())
    return found.select(
        "image_id", "path", F.col("label").alias("true_class"), "skin_tone_class",
        L.map_values(F.col("skin_tone_class"), strata).alias("tone_tertile"), "source", F.col("arm").alias("mapping"),
    )
