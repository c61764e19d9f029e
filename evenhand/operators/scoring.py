"""Batch scoring of one or several models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evenhand.functions.labels import predicted_class


def batch_scores(
    df: DataFrame, models: Mapping[str, Callable[[], Callable]], features: str, width: int,
    classes: Sequence[str], carry: Sequence[str], batch_size: int = 1024,
) -> DataFrame:
    """(carry, model, pred_class, confidence, probs) for every model.

    Each entry is a factory, called once per Python worker, that returns a function
    from a batch of feature rows to a batch of probability rows over ``classes``. The
    features cross to Python once: one function holds all models and returns their
    probabilities side by side.
    """
    factories = list(models.values())

    def load_all() -> Callable:
        loaded = [factory() for factory in factories]
        return lambda batch: np.concatenate([np.asarray(score(batch), dtype="float64") for score in loaded], axis=1)

    scorer = predict_batch_udf(
        load_all, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    n = len(classes)
    outputs = F.array(*[
        F.struct(F.lit(tag).alias("model"), F.slice("_all", 1 + i * n, n).alias("probs")) for i, tag in enumerate(models)
    ])
    scored = df.select(*carry, scorer(F.col(features)).alias("_all"))
    return scored.select(*carry, F.inline(outputs)).withColumns({
        "pred_class": predicted_class(F.col("probs"), classes), "confidence": F.array_max("probs")})


def class_means(df: DataFrame, label: str, features: str, dims: int) -> DataFrame:
    """(class, mean): average vector per class, partially aggregated before the shuffle."""
    return df.groupBy(F.col(label).alias("class")).agg(
        F.array(*[F.avg(F.get(F.col(features), F.lit(i)).cast("double")) for i in range(dims)]).alias("mean"))


def nearest_mean_scores(
    df: DataFrame, means: DataFrame, features: str, dims: Mapping[str, int], carry: Sequence[str]
) -> DataFrame:
    """(carry, model, scores): negative squared distance to each class mean.

    One model per number of leading dimensions. The means are one row (classes x
    dims numbers) attached as a scalar subquery, in class order.
    """
    table = means.agg(F.array_sort(F.collect_list(F.struct("class", "mean")))).scalar()
    rows = df.select(*carry, F.col(features).alias("_x"), table.alias("_means"))

    def distance(mean: Column, width: int) -> Column:
        gaps = F.zip_with(F.slice("_x", 1, width), F.slice(mean, 1, width), lambda a, b: (a - b) * (a - b))
        return -F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)

    models = F.array(*[
        F.struct(F.lit(tag).alias("model"), F.transform("_means", lambda m: distance(m["mean"], width)).alias("scores"))
        for tag, width in dims.items()
    ])
    return rows.select(*carry, F.inline(models))


def nearest_mean_factory(means: np.ndarray) -> Callable[[], Callable]:
    """Factory for :func:`batch_scores`: nearest class mean with softmax over ``means`` (classes x dims)."""

    def load() -> Callable:
        squares = (means**2).sum(axis=1)

        def predict(batch: np.ndarray) -> np.ndarray:
            x = np.asarray(batch, dtype="float64")[:, : means.shape[1]]
            scores = -((x**2).sum(axis=1, keepdims=True) - 2.0 * x @ means.T + squares)
            exps = np.exp(scores - scores.max(axis=1, keepdims=True))
            return exps / exps.sum(axis=1, keepdims=True)

        return predict

    return load
