"""Joins and unions of labels, strata, predictions, metadata and synthetic items.

All joins are equi-joins without hints: sizes decide at run time (AQE) whether a
side is broadcast, and skewed keys are split by AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.labels import one_hot_label
from evenhand.operators.metrics import literal_array
from evenhand.schemas import require_columns
from evenhand.session import settle


def label_ground_truth(
    one_hot: DataFrame, classes: Sequence[str], item: str = "image_id",
    unknown: str = "UNK", include_unknown: bool = False,
) -> DataFrame:
    """(image_id, true_class) from a one-hot table.

    Rows flagged unknown are dropped, or kept as a real class of that name.
    """
    require_columns(one_hot, classes)
    flag = unknown if unknown in one_hot.columns and unknown not in classes else None
    label = one_hot_label(classes, flag, include_unknown)
    return one_hot.select(F.col(item).alias("image_id"), label.alias("true_class")).where(
        F.col("true_class").isNotNull()
    )


def long_predictions(
    predictions: DataFrame, classes: Sequence[str], item: str = "image_id", model: str = "model"
) -> DataFrame:
    """(model, image_id, pred_class, probs) from wide ``prob_<class>`` columns; classes by name."""
    probs = F.array(*[F.col(f"prob_{c}").cast("double") for c in classes])
    return require_columns(predictions, [f"prob_{c}" for c in classes]).select(
        model, F.col(item).alias("image_id"),
        F.get(literal_array(classes), F.col("pred_idx")).alias("pred_class"), probs.alias("probs"),
    )


def build_merged(
    strata: DataFrame, truth: DataFrame, predictions: DataFrame,
    item: str = "image_id", min_confidence: float | None = None, confidence: str = "confidence",
    exclude_flag: str | None = None,
) -> DataFrame:
    """Inner join strata x truth x predictions, all models at once in long form.

    The narrow sides, one row per item, are joined first and settled, so that the
    join with the predictions is a plain two-table join: a broadcast if the items
    are few, else a shuffle in which AQE can split a hot item. Filters sit before
    the join.
    """
    kept = strata
    if min_confidence is not None:
        kept = kept.where(F.col(confidence) >= min_confidence)
    if exclude_flag is not None:
        kept = kept.where(~F.col(exclude_flag))
    return predictions.join(settle(kept.join(truth, item), "items"), item)


def apply_taxonomy(df: DataFrame, mapping: DataFrame, raw: str, arms: Sequence[str] | None = None) -> DataFrame:
    """Map raw labels for one or several arms at once; unmapped rows are dropped.

    ``mapping`` is (arm, raw_label, label); a row appears once per arm that maps it.
    """
    table = require_columns(mapping, ["arm", "raw_label", "label"])
    if arms is not None:
        table = table.where(F.col("arm").isin(list(arms)))
    return df.join(settle(table, "taxonomy"), F.col(raw) == F.col("raw_label")).drop("raw_label")


def detect_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present in the table."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        require_columns(df, [" or ".join(candidates)])
    return found


# Column names tried in order.
ID_COLUMNS = ["isic_id", "image_id", "image", "lesion_id", "id"]
TRUTH_ID_COLUMNS = ["image", "image_id"]
SITE_COLUMNS = ["attribution", "lesion_id", "anatom_site_general", "anatom_site_general_challenge",
                "dataset", "source"]
SOURCE_COLUMNS = ["attribution", "dataset", "source", "study"]


def add_metadata(
    df: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str], fill: Mapping[str, str] | None = None
) -> DataFrame:
    """Left join of optional metadata, one row per key on the right.

    Columns missing in ``metadata`` are skipped. The right side keeps the smallest
    row per key, so the result does not depend on row order.
    """
    present = [c for c in columns if c in metadata.columns]
    if not present:
        return df
    row = F.struct(*[F.col(c) for c in present])
    unique = metadata.groupBy(key).agg(F.min(row).alias("_m")).select(key, "_m.*")
    joined = df.join(unique, key, "left")
    return joined.fillna({c: v for c, v in (fill or {}).items() if c in present})


def bridge_raters(
    predictions: DataFrame, bridge: DataFrame, ratings: DataFrame,
    item: str = "isic_id", tag: str = "tag_id", raters: Sequence[str] = ("mst_r1", "mst_r2"),
) -> DataFrame:
    """Prediction -> tag -> ratings through two distinct maps; differing ratings fan out."""
    pairs = bridge.select(item, tag).distinct()
    values = ratings.select(tag, *raters).distinct()
    return predictions.join(pairs, item).join(values, tag)


def overlay(
    df: DataFrame, other: DataFrame, key: str, columns: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Left join in which the right side overrides same-named fields; defaults fill what is still NULL.

    The right side is reduced to its smallest row per key, so rows are never multiplied.
    """
    defaults = defaults or {}
    row = F.min(F.struct(*[F.col(c) for c in columns]))
    right = other.groupBy(F.col(key).alias("_k")).agg(row.alias("_m")).select(
        "_k", *[F.col(f"_m.{c}").alias(f"_o_{c}") for c in columns])
    joined = df.join(right, F.col(key) == F.col("_k"), "left")
    merged = {}
    for c in columns:
        options = [F.col(f"_o_{c}")]
        if c in df.columns:
            options.append(F.col(c))
        if c in defaults:
            options.append(defaults[c])
        merged[c] = F.coalesce(*options)
    return joined.withColumns(merged).drop("_k", *[f"_o_{c}" for c in columns])


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")


def inherit_labels(manifest: DataFrame, truth: DataFrame, label: str = "true_class") -> DataFrame:
    """(image_id, true_class, path) of synthetic items, which carry the label of their source."""
    return manifest.join(truth.select(F.col("image_id").alias("source_id"), label), "source_id").select(
        F.concat(F.lit("aug_"), F.col("output_name")).alias("image_id"), label,
        F.concat_ws("/", "target_class", "output_name").alias("path"),
    )


def union_synthetic(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Originals and synthetic items with an ``is_synthetic`` flag."""
    return original.withColumn("is_synthetic", F.lit(False)).unionByName(
        synthetic.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True
    )


def union_pairs(automatic: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Automatic and manual pairs; the manual side may be missing or lack columns."""
    if manual is None:
        return automatic
    return automatic.unionByName(manual, allowMissingColumns=True)


def distinct_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, whatever the input order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    best = F.min_by(row, F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def conform(
    df: DataFrame, rename: Mapping[str, str] | None = None, keep: Sequence[str] | None = None,
    missing: Mapping[str, Column] | None = None, fill: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename, add columns that are missing, keep the listed columns that exist, fill NULLs."""
    result = df.withColumnsRenamed(dict(rename or {}))
    result = result.withColumns({c: v for c, v in (missing or {}).items() if c not in result.columns})
    if keep is not None:
        result = result.select(*[c for c in keep if c in result.columns])
    return result.fillna(dict(fill)) if fill else result
