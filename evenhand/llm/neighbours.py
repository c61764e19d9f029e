"""Nearest neighbours by largest inner product over sharded small-world graphs.

Vectors get one more component that brings them to one length, so that the graph of
unit vectors ranks them by inner product. Every query block asks every shard; the
shards' results are merged and ranked by the exact score of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evenhand.llm.hnsw import search
from evenhand.llm.vectors import Shard, ask_all, shard_graphs, usable
from evenhand.session import reliable_checkpoint

BEAM = 64
WIDEST = 4  # a beam of 1 / WIDEST of a shard is widened to the whole shard, which is then compared directly
AUDITED = 32  # queries of a block that are compared with the whole shard
DIRECT_ROWS = 256  # queries that are compared with the whole shard at a time
WALKED = 1 << 20  # places in the beams of the queries that walk together


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors with one more component, in the order of the inner product with any lifted query."""
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    scaled = vectors / sizes.max()
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (sizes / sizes.max()) ** 2))])


def best_points(shard: Shard, queries: np.ndarray, k: int, recall: float) -> np.ndarray:
    """[queries, k or more] points of largest inner product, -1 for none.

    The beam is widened until the audit finds ``recall`` of them. A beam of a quarter of the
    shard is not walked: the queries are then compared with all of its points.
    """
    n = len(shard.graph.points)
    k = min(k, n)
    asked = np.hstack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((len(queries), 1))])
    audit = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(np.int64)
    scores = queries[audit] @ shard.vectors.T
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    beam = max(BEAM, 2 * k)
    while beam * WIDEST < n:
        _, found = search(shard.graph, asked[audit], beam)
        hits = np.take_along_axis(scores, np.maximum(found, 0), axis=1) >= least[:, None]
        if (hits & (found >= 0)).sum() >= recall * k * len(audit):
            return np.concatenate([search(shard.graph, asked[i:i + WALKED // beam], beam)[1]
                                   for i in range(0, len(asked), WALKED // beam)])
        beam *= 2
    return np.concatenate([np.argpartition(-(queries[i:i + DIRECT_ROWS] @ shard.vectors.T), k - 1, axis=1)[:, :k]
                           for i in range(0, len(queries), DIRECT_ROWS)])


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            recall: float = 0.98) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest rows of ``table`` for each row of ``queries``.

    Nearest is the largest inner product in double precision, ties to the smaller key;
    rows with the query's own key are left out. Fewer candidates than ``k`` are all
    returned. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null key, take no part; vectors of different lengths do not meet.
    Equal vectors are one point of the graph, which stands for its ``k + 1`` smallest
    keys: no more can be among the nearest. Repeated candidates count one by one, a
    repeated query once. ``recall`` is the share of a shard's nearest that the audit of
    each block must find. Empty tables give an empty table; other columns are not read.
    """
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        usable("vector") & F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    points = reliable_checkpoint(first.groupBy("vector").agg(
        F.min("id").alias("number"), F.lit(1).cast("long").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")),
        "points")
    asked = queries.select(F.col(key).alias("number"), F.col(vector).cast("array<double>").alias("vector")).where(
        usable("vector") & F.col("number").isNotNull()).dropDuplicates(["number", "vector"])
    graphs = shard_graphs(points.select("number", "vector", "n"), lifted)

    def ask(shard: Shard, numbers: np.ndarray, vectors: np.ndarray) -> pa.Table:
        found = best_points(shard, vectors, k + 1, recall)
        at, slot = np.nonzero(found >= 0)
        point = found[at, slot]
        scores = np.empty(len(at))
        for start in range(0, len(at), 1 << 16):
            part = slice(start, start + (1 << 16))
            scores[part] = np.einsum("id,id->i", vectors[at[part]], shard.vectors[point[part]])
        order = np.lexsort((shard.numbers[point], -scores, at))
        at, point, scores = at[order], point[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        best = place <= k
        return pa.table({"query_id": numbers[at[best]], "number": shard.numbers[point[best]], "score": scores[best]})

    found = ask_all(asked, graphs, lifted, ask, "query_id long, number long, score double")
    members = found.join(points.select("number", "ids"), "number").select("query_id", "score", F.explode("ids").alias(key))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), key))
    ranked = members.where(F.col(key) != F.col("query_id")).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
