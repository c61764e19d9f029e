"""Explicit input schemas and the checks done before any job starts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

# Class spaces and stratum order of the audited classifiers.
MODEL_CLASSES = ["AK", "BCC", "BKL", "DF", "MEL", "NV", "SCC", "UNK", "VASC"]
EVAL_CLASSES = ["AK", "BCC", "BKL", "DF", "MEL", "NV", "SCC", "VASC"]
STRATA = ["Light", "Medium", "Dark"]
OVERALL = "Overall"


class MissingColumnsError(ValueError):
    """Raised before any action when an input lacks a required column."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; present: {df.columns}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, so that NULL is the only missing value."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floating})


def predictions_schema(classes: Sequence[str] = MODEL_CLASSES) -> T.StructType:
    schema = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("pred_idx", T.IntegerType())])
    for c in classes:
        schema = schema.add(f"prob_{c}", T.DoubleType())
    return schema


MANIFEST_SINGLE_RATER = (
    T.StructType()
    .add("image_id", "string").add("path", "string").add("true_idx", "integer").add("true_class", "string")
    .add("skin_tone_class", "integer").add("tone_tertile", "string").add("source", "string").add("mapping", "string")
)

RAW_DUAL_RATER = (
    T.StructType()
    .add("md5hash", "string").add("fitzpatrick_scale", "string").add("fitzpatrick_centaur", "string")
    .add("label", "string").add("qc", "string").add("url", "string").add("url_alphanum", "string")
)

CLASS_LABELS = (
    T.StructType().add("image_path", "string").add("image_id", "string")
    .add("predicted_label", "string").add("confidence", "double")
)

CLASSIFIER_RECORD = (
    T.StructType()
    .add("image_id", "string").add("image_path", "string").add("gradcam_overlay_path", "string")
    .add("gradcam_npy_path", "string").add("ground_truth", "string").add("predicted_class", "string")
    .add("predicted_name", "string").add("confidence", "double")
    .add("all_scores", T.MapType(T.StringType(), T.DoubleType()))
    .add("gradcam_spatial_region", "string").add("gradcam_intensity", "string")
    .add("expected_keywords", T.ArrayType(T.StringType())).add("cnn_correct", "boolean")
)

CONVERSATION = T.StructType([
    T.StructField("messages", T.ArrayType(
        T.StructType()
        .add("role", "string")
        .add("content", T.ArrayType(T.StructType().add("type", "string").add("image", "string").add("text", "string")))
    ))
])

PAIR = (
    T.StructType()
    .add("prompt", "string").add("chosen", "string").add("rejected", "string")
    .add("chosen_score", T.DecimalType(3, 2)).add("rejected_score", T.DecimalType(3, 2)).add("source", "string")
)
