"""Near-duplicate vectors: every vector asks the graph of every shard, links are verified, components united.

Equal vectors are one point with a count. A beam is widened until an audit finds, query by
query, all links that a comparison with the whole shard finds, and for single queries as
long as it holds nothing but links, so a large group of near copies is found whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.components import components
from evenhand.llm.hnsw import search
from evenhand.llm.simhash import roots_of
from evenhand.llm.vectors import Shard, ask_all, shard_graphs, usable
from evenhand.session import reliable_checkpoint

BEAM = 32
WIDEST = 16  # a beam of 1 / WIDEST of a shard is widened to the whole shard, which is then compared directly
AUDITED = 1_024  # queries of a block that are compared with the whole shard, to find some that have links
JUDGED = 256  # of these, queries that judge a beam
LEAST_JUDGED = 8  # with fewer queries that have links, the nearest points of others are judged as well
LARGE = 64  # queries with more links are of large groups
LARGE_JUDGED = 16  # queries of large groups among those that judge
DIRECT_ROWS = 64  # queries that are compared with the whole shard at a time
WALKED = 1 << 20  # places in the beams of the queries that walk together
SLACK = 1e-4  # single precision of the walk; every link is verified in double precision


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very small and very large components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def audit(shard: Shard, numbers: np.ndarray, units: np.ndarray, all_units: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(query row, points that a walk must meet) of some queries, by comparison with the whole shard.

    The points are all links of the query, its own row left out. Large groups have a small
    part of the judges, however many queries are of them. If few queries have links, others
    take part with their nearest point, whatever its cosine.
    """
    small, large, other = [], [], []
    tried = np.linspace(0, len(units) - 1, min(AUDITED, len(units))).astype(np.int64)
    for start in range(0, len(tried), DIRECT_ROWS):
        part = tried[start:start + DIRECT_ROWS]
        whole = units[part] @ all_units.T
        whole[shard.numbers[None, :] == numbers[part][:, None]] = -2.0
        for query, cosines in zip(part.tolist(), whole):
            links = np.flatnonzero(cosines >= threshold)
            if not len(links):
                other.append((query, np.array([cosines.argmax()])))
            else:
                (small if len(links) <= LARGE else large).append((query, links))
    judges = small[:JUDGED - LARGE_JUDGED] + large[::max(1, len(large) // LARGE_JUDGED)][:LARGE_JUDGED]
    return judges if len(judges) >= LEAST_JUDGED else judges + other[:JUDGED - len(judges)]


def enough(shard: Shard, units: np.ndarray, judges: list[tuple[int, np.ndarray]], threshold: float, recall: float, beam: int) -> bool:
    """Whether walks that begin with this beam meet all points of the judging queries, for a share ``recall`` of them.

    As in the search itself, a query whose beam holds links only walks again with twice the
    beam, and what would be compared directly is met.
    """
    left, met = list(judges), 0
    while left and beam * WIDEST < len(shard.graph.points):
        sims, found = search(shard.graph, units[[query for query, _ in left]], beam)
        full = (sims >= threshold - SLACK).all(axis=1)
        met += sum(np.isin(points, near).all() for (_, points), near, again in zip(left, found, full) if not again)
        left = [judge for judge, again in zip(left, full) if again]
        beam *= 2
    return met + len(left) >= recall * len(judges)


def close_points(shard: Shard, numbers: np.ndarray, units: np.ndarray, threshold: float,
                 recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, point) with cosine at or above ``threshold``, some at a time, as the graph finds them with audited beams."""
    n = len(shard.graph.points)
    all_units = unit_rows(shard.vectors)
    beam = min(BEAM, n)
    judges = audit(shard, numbers, units, all_units, threshold) if beam * WIDEST < n and len(units) else []
    while beam * WIDEST < n and judges and not enough(shard, units, judges, threshold, recall, beam):
        beam *= 2
    rows = np.arange(len(units))
    while len(rows) and beam * WIDEST < n:
        wider = []
        for start in range(0, len(rows), max(1, WALKED // beam)):
            part = rows[start:start + max(1, WALKED // beam)]
            sims, points = search(shard.graph, units[part], beam)
            near = sims >= threshold - SLACK
            full = near.all(axis=1)  # holds links only: asks again with twice the beam
            wider.append(part[full])
            at, slot = np.nonzero(near & ~full[:, None])
            at, points = part[at], points[at, slot]
            for first in range(0, len(at), 1 << 16):
                few = slice(first, first + (1 << 16))
                exact = np.einsum("id,id->i", units[at[few]], all_units[points[few]]) >= threshold
                yield at[few][exact], points[few][exact]
        rows, beam = np.concatenate(wider), 2 * beam
    for start in range(0, len(rows), DIRECT_ROWS):
        part = rows[start:start + DIRECT_ROWS]
        at, points = np.nonzero(units[part] @ all_units.T >= threshold)
        yield part[at], points


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
                 recall: float = 0.99) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``table``.

    Rows link if their cosine in double precision is at least ``threshold``; ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest key that
    links reach, ``kept`` tells whether it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths or rows with a null key (their component is null, ``kept`` false).
    Equal vectors link always and are one point, however many; repeated rows count one
    by one. ``recall`` is the share of audited queries whose links must all be found. An empty table
    gives an empty table; other columns are not read.
    """
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    valid = rows.where(usable("vector") & F.col("id").isNotNull())
    points = reliable_checkpoint(valid.groupBy("vector").agg(
        F.min("id").alias("number"), F.count(F.lit(1)).alias("n")).select("number", "vector", "n"), "points")
    graphs = shard_graphs(points, unit_rows)

    def ask(shard: Shard, numbers: np.ndarray, vectors: np.ndarray) -> pa.Table:
        """One link per point to the smallest that this task's links reach; (a, a, n): n rows link to a here.

        Links are united and counted as they are found; none are kept.
        """
        nodes, code = np.unique(np.concatenate([numbers, shard.numbers]), return_inverse=True)
        of_query, of_point = code[:len(numbers)], code[len(numbers):]
        n = np.zeros(len(numbers), np.int64)

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at, point in close_points(shard, numbers, unit_rows(vectors), threshold, recall):
                other = of_query[at] != of_point[point]
                at, point = at[other], point[other]
                n[:] += np.bincount(at, weights=shard.counts[point], minlength=len(n)).astype(np.int64)
                yield of_query[at], of_point[point]

        root = roots_of(len(nodes), links())
        linked, asked = np.flatnonzero(root != np.arange(len(nodes))), np.flatnonzero(n)
        return pa.table({
            "a": np.concatenate([nodes[linked], numbers[asked]]), "b": np.concatenate([nodes[root[linked]], numbers[asked]]),
            "n": np.concatenate([np.zeros(len(linked), np.int64), n[asked]])})

    found = reliable_checkpoint(
        ask_all(points.select("number", "vector"), graphs, unit_rows, ask, "a long, b long, n long"), "found")
    roots = components(found.select("a", "b"))
    direct = found.where(F.col("a") == F.col("b")).groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("direct"))
    judged = points.join(direct, "number", "left").join(
        roots.withColumnRenamed("node", "number"), "number", "left").select(
        F.col("vector").alias("_vector"), (F.coalesce("direct", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "number").alias("component_id"))
    return rows.join(judged, (rows["vector"] == judged["_vector"]) & rows["id"].isNotNull(), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
