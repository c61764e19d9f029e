"""Vector tables cut into shards, each with a small-world graph that is written once.

Shared by the near-duplicate operator and the nearest-neighbour search. A shard is
bounded in bytes, so the number of shards grows with the table; its graph is one row
of flat arrays in the shared folder, and a lost executor costs no graph that is
written. Queries come in groups of bounded size, and every group meets every shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evenhand.llm.hnsw import WIDTH, Graph, build
from evenhand.session import reliable_checkpoint

LEAST_SHARDS = 6
SHARD_BYTES = 64 << 20  # of the vectors of a shard in double precision
GROUP_ROWS = 32_768  # queries that meet a shard in one task; each such group has the shard's graph sent to it
BLOCK_ROWS = 8_192  # of these, queries that are asked at a time
SPREAD = 4  # partitions for each group, so that few groups meet in one


def usable(vector: str) -> Column:
    """True for vectors that are there, finite in every component and not zero."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(parts, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def shard_graphs(vectors: DataFrame, unit: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One row of flat arrays for each shard of the points (number, vector, n); ``n`` rides along.

    ``unit`` turns the matrix of a shard into the unit vectors of its graph. Vectors of
    different lengths never share a shard.
    """
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    shards = max(LEAST_SHARDS, -(-size.n * (size.dim or 0) * 8 // SHARD_BYTES))
    placed = vectors.select(
        F.size("vector").alias("dim"), F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int").alias("shard"),
        "number", "vector", "n")

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        points = matrix(table["vector"])
        made, order = build(unit(points), seed=table["shard"][0].as_py())
        return pa.table({
            "dim": table["dim"][:1], "shard": table["shard"][:1],
            "numbers": [table["number"].to_numpy().astype("<i8")[order].tobytes()],
            "counts": [table["n"].to_numpy().astype("<i8")[order].tobytes()],
            "vectors": [points[order].astype("<f8").tobytes()],
            "sizes": [[len(l) for l in made.layers]],
            "links": [b"".join(l.astype("<i4").tobytes() for l in made.layers)],
        }, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("numbers", pa.binary()),
                             ("counts", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int64())),
                             ("links", pa.binary())]))

    built = placed.repartition(SPREAD * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(
        graph, "dim int, shard int, numbers binary, counts binary, vectors binary, sizes array<long>, links binary")
    return reliable_checkpoint(built, "graphs")


class Shard:
    """A shard's graph as it is read back: ``numbers`` and ``vectors`` are in the order of its points."""

    def __init__(self, row: dict, unit: Callable[[np.ndarray], np.ndarray]):
        self.numbers = np.frombuffer(row["numbers"], "<i8")
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.numbers), row["dim"])
        flat = np.frombuffer(row["links"], "<i4")
        layers, at = [], 0
        for layer, n in enumerate(row["sizes"]):
            width = WIDTH * (2 if layer == 0 else 1)
            layers.append(flat[at:at + n * width].reshape(n, width))
            at += n * width
        self.graph = Graph(np.ascontiguousarray(unit(self.vectors), np.float32), layers)


def ask_all(queries: DataFrame, graphs: DataFrame, unit: Callable[[np.ndarray], np.ndarray],
            ask: Callable[[Shard, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Every group of ``queries`` (number, vector) asks every shard of its length: ``ask(shard, numbers, vectors)``."""
    n = queries.count()
    blocks = max(1, -(-n // GROUP_ROWS))
    block = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(blocks)).cast("int")
    shards = graphs.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    asked = queries.select(F.size("vector").alias("dim"), block.alias("block"), "number", "vector").join(
        F.broadcast(shards), "dim")  # as many rows as shards
    given = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = SPREAD * blocks * max(LEAST_SHARDS, graphs.count())
    key = ["dim", "shard", "block"]

    def run(block: pa.Table, graph: pa.Table) -> pa.Table:
        if not block.num_rows or not graph.num_rows:
            return empty
        block = block.sort_by("number")
        shard = Shard(graph.select(["dim", "shard", "numbers", "counts", "vectors", "sizes", "links"]).to_pylist()[0], unit)
        parts = [block.slice(i, BLOCK_ROWS) for i in range(0, block.num_rows, BLOCK_ROWS)]
        return pa.concat_tables([ask(shard, p["number"].to_numpy().astype(np.int64), matrix(p["vector"])) for p in parts])

    result = graphs.sparkSession.createDataFrame([], schema).schema
    empty = to_arrow_schema(result).empty_table()
    return asked.repartition(parts, *key).groupBy(*key).cogroup(
        given.repartition(parts, *key).groupBy(*key)).applyInArrow(run, result)
