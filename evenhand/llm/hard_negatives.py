"""Hard negatives from blocks of vectors in Hilbert order with zone maps.

All rows are sorted along a Hilbert curve and written once as Parquet: shards of bounded
bytes, in them blocks of ``BLOCK_ROWS`` vectors, with the smallest and largest value of
every dimension for each block and each shard. Interval arithmetic on these ranges bounds
the inner products of an anchor with all rows of a block, so an anchor is sent only to
shards, and there compared only with blocks, whose bounds meet one of its windows.

The search runs twice: once for the positives of each anchor, with one window that is
open above, and once for the negatives, with one window below each positive's score. Each
time the anchor's own shard is asked first; what it yields narrows the windows for the
others. Anchors travel to the shards and pass a shard's blocks batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evenhand.llm.hilbert import cells, hilbert_keys, planes
from evenhand.llm.texts import bounded_batches
from evenhand.llm.vectors import LEAST_SHARDS, SHARD_BYTES
from evenhand.session import reliable_checkpoint

BLOCK_ROWS = 512
ASKED_ROWS = 1_024  # anchors that pass the blocks together
ZONE_ROWS = 1_024  # shards whose zone maps a task holds
SLICE_ROWS = 8_192  # anchors that meet one set of zone maps in a task
HITS = 1 << 16  # hits that are kept before they are cut to the best
LEAST, MOST = -(2 ** 63), 2 ** 63 - 1

TABLE = ("shard long, kind string, dim int, number long, label string, numbers binary, labels array<string>, "
         "vectors binary, lows binary, highs binary")


def packed(vectors: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes."""
    most = int(np.abs(vectors.astype(np.float64)).max(initial=0))
    return vectors.astype("<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<i8").tobytes()


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<i8"}[len(data) // (n * dim)]).reshape(n, dim).astype(np.int64)


def whole_rows(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products, exact: single or double precision where it holds them, else whole numbers of any size.

    A product beyond 64 bits is the nearest 64-bit number.
    """
    size = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0)) * left.shape[1]
    if size < 2 ** 53:
        kind = np.float32 if size < 2 ** 24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    return np.clip(left.astype(object) @ right.astype(object).T, LEAST, MOST).astype(np.int64)


def bounds(vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with any row inside each box, by interval arithmetic."""
    up, down = np.maximum(vectors, 0).astype(np.float64), np.minimum(vectors, 0).astype(np.float64)
    lows, highs = lows.astype(np.float64).T, highs.astype(np.float64).T
    least, most = up @ lows + down @ highs, up @ highs + down @ lows
    slack = 1e-9 * (up.sum(axis=1) - down.sum(axis=1))[:, None] * np.maximum(np.abs(lows), np.abs(highs)).max(axis=0, initial=0)
    return least - slack, most + slack


def write_blocks(points: DataFrame) -> DataFrame:
    """The written table of blocks, zone maps and anchors of (number, label, vector, asked)."""
    spark = points.sparkSession
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"),
                      F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    low, high = float(size.low or 0), float(size.high or 0) + 1
    shards = max(LEAST_SHARDS, -(-size.n * (size.dim or 0) * 8 // SHARD_BYTES))
    kinds = spark.createDataFrame([], TABLE).schema
    schema = to_arrow_schema(kinds)

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        sizes = batch.column(batch.schema.get_field_index("vector")).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            yield dim, batch.take(pa.array(np.flatnonzero(sizes == dim)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                bits = planes(dim)
                grid = cells(whole_rows(part.column(2), dim).astype(np.float64), low, high, bits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hilbert_keys(grid, bits), pa.binary())],
                                                 [*part.schema.names, "place"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        zones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left: dict[int, list[pa.RecordBatch]] = {}

        def rows(kind: str, dim: int, **columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            given = {"shard": [shard] * n, "kind": [kind] * n, "dim": [dim] * n} | columns
            return pa.RecordBatch.from_arrays(
                [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

        def block(dim: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
            vectors = whole_rows(part["vector"].combine_chunks(), dim)
            lows, highs = vectors.min(axis=0), vectors.max(axis=0)
            a, b = zones.get(dim, (lows, highs))
            zones[dim] = np.minimum(a, lows), np.maximum(b, highs)
            numbers, labels = part["number"].to_numpy(), part["label"].to_pylist()
            yield rows("block", dim, numbers=[numbers.astype("<i8").tobytes()], labels=[labels], vectors=[packed(vectors)],
                       lows=[lows.astype("<i8").tobytes()], highs=[highs.astype("<i8").tobytes()])
            asked = np.flatnonzero(part["asked"].to_numpy(zero_copy_only=False))
            if len(asked):
                yield rows("anchor", dim, number=numbers[asked], label=[labels[i] for i in asked],
                           vectors=[packed(vectors[i]) for i in asked])

        for batch in batches:
            for dim, part in by_length(batch):
                table = pa.Table.from_batches([*left.pop(dim, []), part])
                full = table.num_rows // BLOCK_ROWS * BLOCK_ROWS
                for at in range(0, full, BLOCK_ROWS):
                    yield from block(dim, table.slice(at, BLOCK_ROWS))
                if table.num_rows > full:
                    left[dim] = table.slice(full).combine_chunks().to_batches()
        for dim, parts in left.items():
            yield from block(dim, pa.Table.from_batches(parts))
        for dim, (a, b) in zones.items():
            yield rows("zone", dim, lows=[a.astype("<i8").tobytes()], highs=[b.astype("<i8").tobytes()])

    along = points.select("number", "label", "vector", "asked").mapInArrow(
        keyed, "number long, label string, vector array<long>, asked boolean, place binary")
    dealt = along.withColumn("dim", F.size("vector")).repartitionByRange(shards, "dim", "place", "number").sortWithinPartitions(
        "dim", "place", "number")
    return reliable_checkpoint(dealt.drop("dim", "place").mapInArrow(written, kinds), "blocks")


@dataclass
class Asked:
    """Anchors with their windows; a window is empty where low is above high."""

    numbers: np.ndarray
    labels: list[str]
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray


def read_asked(rows: list[dict], dim: int) -> Asked:
    return Asked(
        np.array([r["number"] for r in rows], np.int64), [r["label"] for r in rows],
        np.concatenate([unpacked(r["vectors"], 1, dim) for r in rows]),
        np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64))


def best_hits(hits: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The first ``most`` (row, window, score, number) of each row and window by score, then number."""
    row, window, score, number = (np.concatenate([h[i] for h in hits]) for i in range(4))
    order = np.lexsort((number, -score, window, row))
    row, window, score, number = row[order], window[order], score[order], number[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    kept = place < most
    return row[kept], window[kept], score[kept], number[kept]


def search(asked: Asked, blocks: list[dict], same: bool, most: int) -> tuple[np.ndarray, ...]:
    """(row, window, score, number): the best ``most`` of these blocks in each window of each anchor.

    Blocks come in the order of their bounds; once a window holds ``most`` rows, its lower
    end rises to the last of them.
    """
    least, greatest = bounds(asked.vectors, np.stack([b["lows"] for b in blocks]), np.stack([b["highs"] for b in blocks]))
    low, hits, n = asked.low.copy(), [], 0

    def cut() -> None:
        nonlocal hits, n
        if hits:
            hits = [best_hits(hits, most)]
            row, window, score, _ = hits[0]
            n = 0
            last = np.zeros(low.shape, np.int64)
            np.add.at(last, (row, window), 1)
            floor = np.full(low.shape, MOST)
            np.minimum.at(floor, (row, window), score)
            low[last >= most] = np.maximum(low, floor)[last >= most]

    for at in np.argsort(-greatest.max(axis=0), kind="stable").tolist():
        block = blocks[at]
        near = ((greatest[:, at, None] >= low) & (least[:, at, None] <= asked.high) & (low <= asked.high)).any(axis=1)
        rows = np.flatnonzero(near)
        if not len(rows):
            continue
        scores = products(asked.vectors[rows], block["vectors"])
        codes = {label: i for i, label in enumerate(block["names"])}
        own = np.array([codes.get(asked.labels[i], -1) for i in rows])
        fits = (block["labels"][None, :] == own[:, None]) == same
        fits &= (scores >= low[rows].min(axis=1)[:, None]) & (scores <= asked.high[rows].max(axis=1)[:, None])
        fits &= asked.numbers[rows][:, None] != block["numbers"][None, :]
        r, c = np.nonzero(fits)
        found = scores[r, c]
        inside = (found[:, None] >= low[rows[r]]) & (found[:, None] <= asked.high[rows[r]])
        hit, window = np.nonzero(inside)
        hits.append((rows[r[hit]], window, found[hit], block["numbers"][c[hit]]))
        n += len(hit)
        if n > HITS:
            cut()
    cut()
    none = np.zeros(0, np.int64)
    return hits[0] if hits else (none, none, none, none)


def opened(row: dict) -> dict:
    """A block row as arrays."""
    numbers = np.frombuffer(row["numbers"], "<i8")
    names = sorted(set(row["labels"]))
    code = {label: i for i, label in enumerate(names)}
    return {
        "dim": row["dim"], "numbers": numbers, "names": names, "labels": np.array([code[x] for x in row["labels"]]),
        "vectors": unpacked(row["vectors"], len(numbers), row["dim"]),
        "lows": np.frombuffer(row["lows"], "<i8"), "highs": np.frombuffer(row["highs"], "<i8")}


def streamed(stored: DataFrame, asked: DataFrame, keys: list[str], tasks: int,
             start: Callable[[], Callable[[tuple, list[dict], list[dict]], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """For each key: what is ``stored`` first, then the ``asked`` rows in bounded portions, in one pass."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(asked.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, at, held, waiting = start(), None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if waiting and (key != at or len(waiting) >= ASKED_ROWS):
                    yield from work(at, held, waiting)
                    waiting = []
                if key != at:
                    at, held = key, []
                if row["_turn"]:
                    waiting.append(row)
                else:
                    held.append(row)
        if waiting:
            yield from work(at, held, waiting)

    return dealt.mapInArrow(run, schema)


def found_in(blocks: DataFrame, asked: DataFrame, shards: int, same: bool, most: int) -> DataFrame:
    """(number, window, score, other): what each asked (shard, number, label, vectors, low, high) finds in its shard."""

    def start():
        known: dict[str, list] = {"key": None, "blocks": []}

        def work(key: tuple, held: list[dict], waiting: list[dict]) -> Iterator[pa.RecordBatch]:
            if known["key"] != key:
                known.update(key=key, blocks=[opened(r) for r in held])
            for dim in sorted({r["dim"] for r in waiting}):
                near = [b for b in known["blocks"] if b["dim"] == dim]
                rows = [r for r in waiting if r["dim"] == dim]
                if near:
                    anchors = read_asked(rows, dim)
                    row, window, score, other = search(anchors, near, same, most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors.numbers[row]), pa.array(window.astype(np.int32)), pa.array(score), pa.array(other)],
                        ["number", "window", "score", "other"])

        return work

    stored = blocks.where(F.col("kind") == "block").select("shard", "dim", "numbers", "labels", "vectors", "lows", "highs")
    return streamed(stored, asked.select("shard", "dim", "number", "label", "vectors", "low", "high"), ["shard"], 2 * shards,
                    start, "number long, window int, score long, other long")


def other_shards(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row for every shard but the own whose zone maps meet a window of the anchor."""
    zones = blocks.where(F.col("kind") == "zone").select("shard", "dim", "lows", "highs")
    n_zones, n_anchors = zones.count(), anchors.count()
    sets, slices = max(1, -(-n_zones // ZONE_ROWS)), max(1, -(-n_anchors // SLICE_ROWS))
    stored = zones.withColumn("set", F.pmod(F.xxhash64("shard", "dim"), F.lit(sets)).cast("int")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = anchors.withColumn("slice", F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int")).withColumn(
        "set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).withColumnRenamed("shard", "own")

    def start():
        def work(_: tuple, held: list[dict], waiting: list[dict]) -> Iterator[pa.RecordBatch]:
            for dim in sorted({r["dim"] for r in waiting}):
                zone = [z for z in held if z["dim"] == dim]
                rows = [r for r in waiting if r["dim"] == dim]
                if not zone:
                    continue
                a = read_asked(rows, dim)
                lows, highs = (np.stack([np.frombuffer(z[c], "<i8") for z in zone]) for c in ("lows", "highs"))
                least, greatest = bounds(a.vectors, lows, highs)
                near = ((greatest[:, :, None] >= a.low[:, None, :]) & (least[:, :, None] <= a.high[:, None, :])
                        & (a.low <= a.high)[:, None, :]).any(axis=2)
                near &= np.array([r["own"] for r in rows])[:, None] != np.array([z["shard"] for z in zone])[None, :]
                r, z = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([
                    pa.array([zone[i]["shard"] for i in z], pa.int64()), pa.array([dim] * len(r), pa.int32()), pa.array(a.numbers[r]),
                    pa.array([a.labels[i] for i in r], pa.string()), pa.array([rows[i]["vectors"] for i in r], pa.binary()),
                    pa.array(list(a.low[r]), pa.list_(pa.int64())), pa.array(list(a.high[r]), pa.list_(pa.int64()))],
                    ["shard", "dim", "number", "label", "vectors", "low", "high"])

        return work

    return streamed(stored, asked, ["set", "slice"], 2 * sets * slices, start,
                    "shard long, dim int, number long, label string, vectors binary, low array<long>, high array<long>")


def best_of(found: DataFrame, most: int) -> DataFrame:
    """(number, window, score, other, rank): the first ``most`` of each window by score, then number."""
    order = Window.partitionBy("number", "window").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def asked_everywhere(blocks: DataFrame, anchors: DataFrame, shards: int, same: bool, most: int, name: str) -> DataFrame:
    """The best ``most`` of all shards for (shard, dim, number, label, vectors, low, high): the own shard first."""
    own = reliable_checkpoint(found_in(blocks, anchors, shards, same, most), f"{name}-own")
    filled = own.groupBy("number", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(
        F.col("n") >= most).groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))
    narrowed = anchors.join(filled, "number", "left").withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(
        F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i), x))))).drop("floors")
    rest = found_in(blocks, other_shards(blocks, narrowed), shards, same, most)
    return reliable_checkpoint(best_of(own.unionByName(rest), most), name)


def share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score as a whole number, rounded up or down, exactly."""
    product = score.cast("decimal(38,0)") * F.lit(-percent if up else percent)
    floor = ((product - F.pmod(product, F.lit(100))) / 100).cast("decimal(38,0)")
    return (-floor if up else floor).cast("long")


def hard_negatives(table: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "vector", label: str = "label",
                   positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` holds whole numbers; a score is the inner product with the anchor. Each row
    of ``table`` that the column ``anchors`` marks is an anchor. Its positives are its
    first ``positives`` other rows of the same label by score, ties by smaller key; for
    each positive the first ``negatives`` rows of another label whose score is between
    ``least`` and ``most`` percent of the positive's score are returned, ``rank`` from 1.
    Fewer are returned where there are fewer; an anchor without positives has no rows.

    Rows with a null key, label, vector or component, or an empty vector, take no part;
    vectors of different lengths never meet. Repeated rows count one by one, except that
    an anchor's key is asked once (for the smallest label, then vector) and never meets
    rows of its own key. Scores beyond 64 bits are the nearest 64-bit number. Labels are
    compared as text. An empty table gives an empty table; other columns are not read.
    """
    bounded_batches(table.sparkSession)
    rows = table.select(
        F.col(key).cast("long").alias("number"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    points = rows.where(F.col("number").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
                        & F.forall("vector", lambda x: x.isNotNull()))
    blocks = write_blocks(points)
    shards = blocks.where(F.col("kind") == "zone").count()
    one = F.min(F.struct("label", "vectors", "shard", "dim")).alias("one")
    asked = reliable_checkpoint(
        blocks.where(F.col("kind") == "anchor").groupBy("number").agg(one).select("number", "one.*"), "anchors")
    open_window = asked.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    close = asked_everywhere(blocks, open_window, max(shards, 1), True, positives, "positives")
    windows = close.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("close")).select(
        "number",
        F.concat(F.transform("close", lambda p: share(p["score"], least, True)),
                 F.array_repeat(F.lit(1).cast("long"), F.lit(positives) - F.size("close"))).alias("low"),
        F.concat(F.transform("close", lambda p: share(p["score"], most, False)),
                 F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("close"))).alias("high"))
    hard = asked_everywhere(blocks, asked.join(windows, "number"), max(shards, 1), False, negatives, "negatives")
    named = close.select(F.col("number").alias("anchor_id"), (F.col("rank") - 1).alias("_window"),
                         F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, (hard["number"] == named["anchor_id"]) & (hard["window"] == named["_window"])).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
