"""Table sources: CSV, JSON arrays, JSON lines and per-model prediction files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenhand.schemas import CONVERSATION, MODEL_CLASSES, nan_to_null, predictions_schema, require_columns


def csv_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """Column names of a CSV table; reads one line, infers nothing."""
    return spark.read.option("header", True).csv(path).columns


def _typed(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str]) -> DataFrame:
    """One scan by the header that its files share; a file with another header makes the scan fail."""
    names = csv_header(spark, path)
    missing = [c for c in required if c not in names]
    if missing:
        require_columns(spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names])),
                        missing)
    wanted = {f.name: f.dataType for f in schema.fields}
    file_schema = T.StructType([T.StructField(n, wanted.get(n, T.StringType())) for n in names])
    return spark.read.option("header", True).option("enforceSchema", False).option("nanValue", "nan").schema(
        file_schema).csv(path)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, required: Sequence[str] = ()
) -> DataFrame:
    """CSV by column name: schema columns in the order of the files, missing optional ones as NULL.

    The files of one call must share one header; the scan fails on a file whose header
    differs, so values never land in another column. Required columns are checked
    before any job; ``nan`` becomes NULL. Columns that are not in the schema are not
    parsed.
    """
    raw = _typed(spark, path, schema, required)
    columns = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
               for f in schema.fields]
    return nan_to_null(raw.select(*columns))


MODEL_TAG = r"([^/=]+)_predictions"


def prediction_tags(spark: SparkSession, folder: str) -> dict[str, str]:
    """Path below ``folder`` by model tag; lists names, reads no content."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*_predictions.csv").select(
        F.regexp_extract("path", rf"([^/]*_predictions\.csv)(?:/[^/]*)?$", 1).alias("name")).distinct()
    names = [r["name"] for r in files.collect()]  # one per model
    return {n.rpartition("=")[2].removesuffix("_predictions.csv"): f"{folder.rstrip('/')}/{n}" for n in names}


def read_predictions(
    spark: SparkSession, folder: str, classes: Sequence[str] = MODEL_CLASSES, tags: Sequence[str] | None = None
) -> DataFrame:
    """All ``<tag>_predictions.csv`` files (or folders) below ``folder``, ``model`` from the name.

    Each model is read by its own header, so models may order their columns as they
    like; the parts of one model must agree, or the scan fails.
    """
    schema = predictions_schema(classes)
    found = prediction_tags(spark, folder)
    wanted = sorted(found) if tags is None else list(tags)
    missing = [t for t in wanted if t not in found]
    if missing or not wanted:
        raise FileNotFoundError(f"no prediction files for {missing or 'any model'} in {folder}")
    each = [_typed(spark, found[t], schema, schema.names).select(F.lit(t).alias("model"), *schema.names) for t in wanted]
    return nan_to_null(reduce(DataFrame.unionByName, each))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each.

    Such a file is parsed by one task; ``json_pieces.read_json_pieces`` reads large ones
    in many.
    """
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, optional: bool = False
) -> DataFrame:
    """JSON lines; a missing optional input is an empty table of the schema."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Chat records whose ``content`` is a string or a list of parts, normalised to lists of parts."""
    loose = T.StructType([T.StructField("messages", T.ArrayType(
        T.StructType().add("role", "string").add("content", "string")))])
    part = CONVERSATION["messages"].dataType.elementType["content"].dataType
    raw = spark.read.schema(loose).json(path)

    def normalise(m):
        content = m["content"]
        plain = F.array(F.struct(
            F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), content.alias("text")))
        listed = F.from_json(content, part)
        return F.struct(m["role"].alias("role"),
                        F.when(content.rlike(r'^\[\s*\{\s*"'), listed).otherwise(plain).alias("content"))

    return raw.select(F.transform("messages", normalise).alias("messages"))
