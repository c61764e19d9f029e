"""Maximal periodic runs of words, found in tiles of one size for each octave of periods.

A document is exploded into overlapping tiles: the lower octaves of periods share tiles
of ``CORE`` words, every further octave has tiles twice as long. A tile needs no other
tile. In it every boundary (a multiple of half the octave's shortest period) gets the
Z-function of its shifts: how far the words behind the boundary equal the words a shift
later. Window hashes rule out the shifts whose Z-value is shorter than the step between
boundaries, because a run holds a whole step; the others are measured word by word in
both directions.

What a tile finds are stretches of positions that equal the position one period later,
cut at the tile's ends. They are shuffled by document and period, stitched where they
touch, and are runs if they are long enough. A run of smallest period q also has the
periods 2q, 3q, ...; these share its ends, and the smallest stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.llm.texts import bounded_batches, coded_words, split_words
from evenhand.session import reliable_checkpoint

LEAST_WORDS = 24  # of a run
LEAST_POWER = 3  # periods of a run
CORE = 1 << 13  # words that a tile of the first class answers for
REACH = CORE // 4  # periods of the first class are shorter
STEP = 8  # the shortest distance of boundaries
BATCH_BYTES = 1 << 20  # of texts whose tiles are solved together
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Tile:
    """Words ``first`` to ``first + len(codes)`` of a document of ``whole`` words."""

    codes: np.ndarray
    first: int
    whole: int
    low: int  # periods from low to high - 1 are looked for
    high: int


def tiles(codes: np.ndarray) -> Iterator[Tile]:
    """The overlapping tiles of one document for every class of periods.

    A tile answers for ``core`` positions and holds a margin of the longest period on
    both sides: a run that touches the core has two periods, and so a whole step between
    boundaries, inside the margins.
    """
    n, low, high, core = len(codes), 1, REACH, CORE
    while LEAST_POWER * low <= n and n >= LEAST_WORDS:
        if n <= core + 3 * high:
            yield Tile(codes, 0, n, low, high)
        else:
            for start in range(0, n, core):
                begin = max(0, start - high)
                yield Tile(codes[begin:start + core + 2 * high], begin, n, low, high)
        low, high, core = high, 2 * high, 2 * core


def scrambled(a: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly over all 64-bit numbers."""
    a = (a ^ (a >> np.uint64(30))) * MIX[0]
    a = (a ^ (a >> np.uint64(27))) * MIX[1]
    return a ^ (a >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of windows from the hashes of their halves."""
    return scrambled(a * MIX[2] + (b ^ (b >> np.uint64(32))) * MIX[1] + np.uint64(1))


def least_equal(period: np.ndarray) -> np.ndarray:
    """Positions that equal the one a period later, in the shortest run of that period."""
    return np.maximum(LEAST_WORDS, LEAST_POWER * period) - period


def prime_factors(most: int) -> np.ndarray:
    """Smallest prime factor of every number up to ``most``."""
    factor = np.arange(most + 1)
    for p in range(2, int(most ** 0.5) + 1):
        if factor[p] == p:
            rest = factor[p * p::p]
            rest[rest == np.arange(p * p, most + 1, p)] = p
    return factor


def has_shorter(windows: np.ndarray, step: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` words from ``at`` repeat a part of them; the period is then not the smallest."""
    if not len(at):
        return np.zeros(0, bool)
    found = np.zeros(len(at), bool)
    factors, rest = prime_factors(int(period.max())), period.copy()
    while (rest > 1).any():
        prime = factors[rest]
        part = period // np.maximum(prime, 1)
        same = rest > 1
        last = np.maximum(period - part - step, 0)
        for start in (0, step, 2 * step, 3 * step, None):  # windows that cover the first period - part words
            here = at + (last if start is None else np.minimum(start, last))
            same &= windows[here] == windows[here + part]
        found |= same
        rest = np.where(rest > 1, rest // np.maximum(prime, 1), 1)
    return found


def extended(flat: np.ndarray, begin: int, end: int, period: int, step: int) -> tuple[int, int]:
    """The largest stretch around [begin, end) whose words equal those a period later."""
    while begin:
        low = max(0, begin - step)
        other = np.flatnonzero(flat[low:begin] != flat[low + period:begin + period])
        if len(other):
            begin = low + int(other[-1]) + 1
            break
        begin = low
    most = len(flat) - period
    while end < most:
        high = min(most, end + step)
        other = np.flatnonzero(flat[end:high] != flat[end + period:high + period])
        if len(other):
            end += int(other[0])
            break
        end = high
    return begin, end


def stretches(group: list[Tile]) -> Iterator[tuple[int, int, int, int]]:
    """(tile, period, begin, end): positions of the document that equal the one a period later.

    Only stretches that may belong to a run: long enough, or cut by an end of the tile
    that is no end of the document. All tiles of ``group`` share the class of periods.
    """
    order = sorted(range(len(group)), key=lambda i: -group[i].whole)
    sizes = np.array([len(group[i].codes) + 1 for i in order], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.append(group[i].codes.astype(np.int64), -1 - at) for at, i in enumerate(order)])
    whole = np.array([group[i].whole for i in order])
    open_left = np.array([group[i].first > 0 for i in order])
    open_right = np.array([group[i].first + len(group[i].codes) < group[i].whole for i in order])
    low, most = group[0].low, group[0].high
    windows, size = scrambled(flat.astype(np.uint64)), 1
    while low < most:
        high = min(most, max(2 * STEP, 2 * low))
        step = max(STEP, low // 2)
        live = int(np.searchsorted(-whole, -LEAST_POWER * low, side="right"))  # documents that hold such a run
        if not live:
            return
        length = int(starts[live - 1] + sizes[live - 1])
        flat, windows = flat[:length], windows[:length]
        while size < step:
            windows = joined(windows[:-size], windows[size:]) if len(windows) > size else windows[:0]
            size *= 2
        if not len(windows):
            return
        padded = np.concatenate([windows, np.zeros(2 * high + 4 * step, np.uint64)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded[low:low + len(windows) + high], high - low)[:len(windows):step]
        block, shift = np.nonzero(shifted == windows[::step, None])
        by_period = np.lexsort((block, shift))
        block, period = block[by_period], shift[by_period] + low
        new = np.ones(len(block), bool)
        new[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(block))[:len(first)] - 1
        begin, end, period = block[first] * step, block[last] * step + step, period[first]
        tile = np.searchsorted(starts, begin, side="right") - 1
        edge = (open_left[tile] & (begin - step < starts[tile])) | (
            open_right[tile] & (end + step + period >= starts[tile] + sizes[tile] - 1))
        full = (end - begin) // step >= (least_equal(period) + 1) // step - 1
        kept = edge | full
        kept[kept] = ~has_shorter(padded, step, begin[kept], period[kept])
        for t, p, a, z in zip(tile[kept].tolist(), period[kept].tolist(), begin[kept].tolist(), end[kept].tolist()):
            if not np.array_equal(flat[a:z], flat[a + p:z + p]):
                continue
            a, z = extended(flat, a, z, p, step)
            a, z = a - int(starts[t]), z - int(starts[t])
            cut = (open_left[t] and a == 0) or (open_right[t] and z + p == sizes[t] - 1)
            if cut or z - a >= max(LEAST_WORDS, LEAST_POWER * p) - p:
                offset = group[order[t]].first
                yield order[t], p, a + offset, z + offset
        low = high


def found_stretches(docs: DataFrame, key: str, text: str, mark: Column) -> DataFrame:
    """(_key, _mark, period, begin, end) of all tiles of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, rows = coded_words(pc.fill_null(batch.column(2), ""))
            ends = np.cumsum(np.bincount(rows, minlength=batch.num_rows))
            by_class: dict[int, list[tuple[int, Tile]]] = {}
            for row, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                for tile in tiles(codes[a:z]):
                    by_class.setdefault(tile.low, []).append((row, tile))
            for group in by_class.values():
                at = [(group[t][0], p, a, z) for t, p, a, z in stretches([tile for _, tile in group])]
                if at:
                    row, period, begin, end = np.array(at, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                         pa.array(period), pa.array(begin), pa.array(end)], ["_key", "_mark", "period", "begin", "end"])

    narrow = docs.select(F.col(key).alias("_key"), mark.alias("_mark"), F.col(text).alias("_text"))
    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"_key {kind}, _mark long, period long, begin long, end long")


def stitched_runs(found: DataFrame) -> DataFrame:
    """(_key, _mark, runs): the runs of each document by start, then period."""
    document = ["_key", "_mark"]
    before = Window.partitionBy(*document, "period").orderBy("begin", "end")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.distinct().withColumn("_new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn(
        "_part", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = parts.groupBy(*document, "period", "_part").agg(F.min("begin").alias("start"), F.max("end").alias("_end"))
    runs = whole.select(*document, "start", (F.col("_end") - F.col("start") + F.col("period")).alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_POWER * F.col("period")))
    smallest = runs.groupBy(*document, "start", "length").agg(F.min("period").alias("period"))
    listed = smallest.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    return listed.select(*document, F.transform("_runs", lambda r: F.struct(
        r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse(joined_docs: DataFrame) -> DataFrame:
    """(_key, n_words, runs, collapsed) from (_key, _text, runs): words after a run's first period go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = split_words(pc.fill_null(batch.column(1), ""))
            sizes = np.bincount(rows, minlength=batch.num_rows)
            begins = np.cumsum(sizes) - sizes
            change = np.zeros(len(words) + 1, np.int64)
            runs = batch.column(2)
            has = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
            flat = runs.flatten()
            start, length, period = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            np.add.at(change, begins[has] + start + period, 1)
            np.add.at(change, begins[has] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.bincount(rows[kept], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(left)]).astype(np.int32), words.filter(pa.array(kept)))
            text = pc.binary_join(lists, " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), runs, text],
                                             ["_key", "n_words", "runs", "collapsed"])

    kind = joined_docs.schema["_key"].dataType.simpleString()
    return joined_docs.select("_key", "_text", "runs").mapInArrow(run, f"_key {kind}, n_words long, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) for every row of ``docs``.

    Words are separated by space and U+0009 to U+000D. ``runs`` is an array of (start,
    length, period), by start and then period: all maximal stretches of words with
    smallest period q and at least max(24, 3 q) words. ``collapsed`` holds the words that
    are in no run after its first q words, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed``; rows with the
    same key and text have the same result, each its own row; rows of one key with other
    texts are kept apart by a 64-bit hash of the text; a null key is a key like others. An
    empty table gives an empty table; other columns are not read. A task holds one whole
    text and the largest of its tiles.
    """
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    mark = F.xxhash64(F.col(text))
    runs = reliable_checkpoint(stitched_runs(found_stretches(docs, key, text, mark)), "runs")
    rows = docs.select(F.col(key).alias("_key"), mark.alias("_mark"), F.col(text).alias("_text"))
    found = runs.select(F.col("_key").alias("_k"), F.col("_mark").alias("_m"), "runs").hint("merge")  # at every size
    both = rows.join(found, rows["_key"].eqNullSafe(found["_k"]) & (rows["_mark"] == found["_m"]), "left").select(
        "_key", "_text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    return collapse(both).withColumnRenamed("_key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first of such; null without runs."""
    return F.aggregate(
        runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda best, r: F.when(
            best.isNull() | (r["length"].cast("decimal(38,0)") * best["period"] > best["length"].cast("decimal(38,0)") * r["period"]), r
        ).otherwise(best))


def listed_runs(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
