"""Principal components of all rows from one table of sums.

Every Arrow batch becomes one block: its row count, sums and products, dims x dims
numbers whatever the batch holds. The blocks are added cell by cell, so the covariance
covers all rows and no row is shuffled. The eigenvectors of the small matrix come from
cyclic Jacobi rotations; projections are plain columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST_SWEEPS = 60


@dataclass
class Components:
    """Mean, unit vectors (a row each) and variances in falling order; ``total`` is the variance in all dimensions."""

    n: int
    mean: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    total: float


def whole_vectors(df: DataFrame, features: str, dims: int) -> DataFrame:
    """(v): arrays of ``dims`` finite numbers; others take no part."""
    values = F.col(features).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(values.alias("v")).where((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))


def product_sums(rows: DataFrame, dims: int, shift: np.ndarray) -> DataFrame:
    """(cell, s): number of rows, sums and products of (v - shift), flat, added over all blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) - shift
            flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], ["sums"])

    cells = rows.select("v").mapInArrow(blocks, "sums array<double>").select(F.posexplode("sums").alias("cell", "s"))
    return cells.groupBy("cell").agg(F.sum("s").alias("s"))


def jacobi(matrix: np.ndarray, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix by cyclic rotations of pairs of rows and columns."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    turned = np.eye(n)
    scale = np.sqrt((a * a).sum()) or 1.0
    for _ in range(MOST_SWEEPS):
        if np.sqrt((np.triu(a, 1) ** 2).sum()) <= tolerance * scale:
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= 1e-300:
                    continue
                angle = 0.5 * np.arctan2(2.0 * a[p, q], a[q, q] - a[p, p])
                c, s = np.cos(angle), np.sin(angle)
                for m in (a, a.T, turned):  # columns, rows, and the product of all rotations
                    left, right = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
                    m[:, p], m[:, q] = left, right
    return np.diag(a).copy(), turned


def signed(vectors: np.ndarray) -> np.ndarray:
    """Rows whose largest component (the first of equal ones) is positive."""
    at = np.abs(vectors).argmax(axis=1)
    return vectors * np.where(vectors[np.arange(len(vectors)), at] < 0, -1.0, 1.0)[:, None]


def principal_components(df: DataFrame, features: str, dims: int, k: int) -> Components:
    """The first ``k`` components of all rows; only dims x dims numbers reach the driver.

    Rows whose array is null, of another length or not finite take no part; with fewer
    than two rows all variances are 0.
    """
    rows = whole_vectors(df, features, dims)
    one = rows.select("v").limit(1).collect()  # any row; only for the accuracy of the sums
    shift = np.array(one[0]["v"]) if one else np.zeros(dims)
    flat = np.zeros(1 + dims + dims * dims)
    for r in product_sums(rows, dims, shift).collect():
        flat[r["cell"]] = r["s"]
    n, sums, products = int(flat[0]), flat[1:1 + dims], flat[1 + dims:].reshape(dims, dims)
    covariance = (products - np.outer(sums, sums) / max(n, 1)) / max(n - 1, 1)
    values, vectors = jacobi((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    return Components(n, shift + sums / max(n, 1), signed(vectors.T[order]), values[order], float(np.trace(covariance)))


def projected(found: Components, features: str) -> Column:
    """Array of the row's coordinates along the components."""
    values = F.transform(F.col(features).cast("array<double>"), lambda x, i: x - F.element_at(
        F.lit(found.mean.tolist()), i + 1))

    def along(vector: np.ndarray) -> Column:
        products = F.zip_with(values, F.lit(vector.tolist()), lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

    return F.array(*[along(v) for v in found.vectors])


def component_table(spark, found: Components) -> DataFrame:
    """(component, variance, share, total): one row a component, from 1."""
    share = lambda v: float(v) / found.total if found.total > 0 else 0.0
    return spark.createDataFrame(
        [(i, float(v), share(v), found.total) for i, v in enumerate(found.variances, 1)],
        "component int, variance double, share double, total double")
