"""Document fingerprints by winnowing.

Every k code points have a rolling hash; of every ``window`` hashes in a row the smallest
is chosen, the rightmost of equal ones. Two texts that share ``window + k - 1`` code points
in a row share a chosen hash, wherever the passage lies; positions tell where.

All texts of a batch are hashed as one array. A long text comes in overlapping blocks,
each of which has all windows that start in it, so the choice is the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.texts import bounded_batches, gather

GRAM = 16  # code points of a hash
WINDOW = 32  # hashes of which one is chosen
BLOCK = 1 << 20  # window starts that are worked on at a time
MOST_CUTS = 10_000  # bound on the ranges of keys
BASE = 0x9E3779B97F4A7C15
NONE = np.uint64(2 ** 64 - 1)


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash modulo 2 ** 64 of the ``gram`` codes from each position on, its bits then mixed to 63."""
    piece, size, whole, covered = codes.astype(np.uint64), 1, None, 0
    while True:
        if gram & size:
            n = len(codes) - covered - size + 1
            power = np.uint64(pow(BASE, size, 2 ** 64))
            whole = piece if whole is None else whole[:n] * power + piece[covered:covered + n]
            covered += size
        if covered == gram:
            break
        piece = piece[:-size] * np.uint64(pow(BASE, size, 2 ** 64)) + piece[size:]
        size *= 2
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (whole ^ (whole >> np.uint64(32))) >> np.uint64(1)


def rightmost_least(values: np.ndarray, window: int) -> np.ndarray:
    """For every window its position of the smallest value, the rightmost of equal ones."""
    best, size = np.arange(len(values)), 1
    while 2 * size <= window:
        left, right = best[:-size], best[size:]
        best, size = np.where(values[right] <= values[left], right, left), 2 * size
    if size < window:
        left, right = best[:len(values) - window + 1], best[window - size:]
        best = np.where(values[right] <= values[left], right, left)
    return best


def chosen(codes: np.ndarray, sizes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, number for each text) of texts that lie one after the other in ``codes``.

    A text shorter than ``gram`` has one hash, of all of it; a text with fewer hashes than
    a window has one window; an empty text has none.
    """
    begins = np.cumsum(sizes) - sizes
    slots = np.where(sizes > 0, np.maximum(sizes, gram), 0)
    at = np.cumsum(slots) - slots
    padded = np.zeros(int(slots.sum()), np.uint64)
    if not len(padded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    place = np.repeat(at - begins, sizes) + np.arange(len(codes))
    padded[place] = codes.astype(np.uint64) + np.uint64(1)
    hashes = rolling(padded, gram)
    grams = np.where(slots > 0, slots - gram + 1, 0)
    room = np.where(grams > 0, np.maximum(grams, window), 0)
    start = np.cumsum(room) - room
    values = np.full(int(room.sum()), NONE)
    values[gather(np.arange(len(values)), start, grams)] = gather(hashes, at, grams)
    best = rightmost_least(values, window)
    windows = np.where(room > 0, room - window + 1, 0)
    picks = gather(best, start, windows)
    picks = picks[np.append(True, picks[1:] != picks[:-1])]
    text = np.searchsorted(start[room > 0], picks, side="right") - 1
    text = np.flatnonzero(room > 0)[text]
    return values[picks].astype(np.int64), picks - start[text], np.bincount(text, minlength=len(sizes))


def fingerprint_all(texts: Sequence[str], gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, at most about ``block`` code points at a time."""
    found: list[tuple[list, list]] = [([], []) for _ in texts]

    def work(pieces: list[tuple[int, int, str]]) -> None:
        codes = np.frombuffer("".join(p for _, _, p in pieces).encode("utf-32-le"), np.uint32)
        hashes, positions, n = chosen(codes, np.array([len(p) for _, _, p in pieces], np.int64), gram, window)
        ends = np.cumsum(n).tolist()
        for (row, first, _), a, z in zip(pieces, [0, *ends[:-1]], ends):
            h, at = hashes[a:z], positions[a:z] + first
            if first and len(h) and at[0] == found[row][1][-1][-1]:  # chosen by the last window of the block before
                h, at = h[1:], at[1:]
            if len(h):
                found[row][0].append(h)
                found[row][1].append(at)

    pieces, total = [], 0
    for row, text in enumerate(texts):
        first = 0
        while True:
            last = len(text) - first <= block + window + gram - 2
            pieces.append((row, first, text[first:] if last else text[first:first + block + window + gram - 2]))
            total += len(pieces[-1][2])
            if total >= block:
                work(pieces)
                pieces, total = [], 0
            if last:
                break
            first += block
    work(pieces)
    none = np.zeros(0, np.int64)
    return [(np.concatenate(h) if h else none, np.concatenate(p) if p else none) for h, p in found]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of both; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, n_chars, prints) for every row: ``prints`` is an array of (hash, position) by position.

    A null or empty text has no prints, a text of fewer than ``gram`` code points one;
    repeated rows are worked on one by one; an empty table gives an empty table; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = fingerprint_all(texts, gram, window)
            offsets = np.concatenate([[0], np.cumsum([len(h) for h, _ in found])]).astype(np.int32)
            prints = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i in (0, 1)], ["hash", "position"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, prints)],
                ["_key", "n_chars", "prints"])

    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"_key {kind}, n_chars long, prints array<struct<hash: bigint, position: bigint>>").withColumnRenamed("_key", key)


# --- each document beside the next one ----------------------------------------


def range_cuts(docs: DataFrame, key: str) -> tuple[list, bool]:
    """(ascending smallest keys of ranges of about equal size, whether there are null keys); only keys are read."""
    spark = docs.sparkSession
    keys = docs.select(F.col(key).alias("_key"))
    ranges = min(MOST_CUTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.rdd.getNumPartitions()))
    parts = keys.repartitionByRange(ranges, "_key").groupBy(F.spark_partition_id().alias("_part")).agg(
        F.min("_key").alias("least"), F.max(F.col("_key").isNull()).alias("null")).collect()  # one row a range
    return sorted({r.least for r in parts if r.least is not None}), any(r.null for r in parts)


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """How many of the sorted ``cuts`` are not above ``key``; 0 for a null key."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    middle = lambda s: F.shiftright(s["low"] + s["high"], 1)
    closer = lambda s, _: F.when(s["low"] >= s["high"], s).when(
        F.element_at(listed, middle(s) + 1) <= key, F.struct((middle(s) + 1).alias("low"), s["high"].alias("high"))
    ).otherwise(F.struct(s["low"].alias("low"), middle(s).alias("high")))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, closer, lambda s: s["low"])
    return F.when(key.isNull(), 0).otherwise(found)


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, n_chars, edited, prints, edited_prints, near_edited, near_next) for every row of ``docs``.

    ``edited`` is the text with its last floor(n_chars / 4) code points replaced by the
    first as many of the next document's text, or by all of a shorter one. The next
    document has the next larger key, after the largest the smallest; of several rows with
    that key the one with the smallest text counts. Null keys come before all others and
    are one key. ``prints`` are the chosen hashes by position; the likenesses compare them
    with those of the edited text and of the next document's text.

    A null text is empty and has no prints; rows with one key have the same next document;
    a table with one key has that document next to itself; an empty table gives an empty
    table; other columns are not read. Texts are shuffled once, by ranges of keys; the
    first document of each range is also sent to the range before. A task walks its range
    from large keys to small ones and holds one batch and one further text.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    cuts, has_null = range_cuts(docs, key)
    last = len(cuts)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumn("_range", range_of(F.col("_key"), cuts, kind))
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = lambda r: F.struct(r.cast("int").alias("range"), F.lit(True).alias("guest"))
    if cuts:
        listed = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
        is_first = (F.col("_range") > 0) & (F.col("_key") == F.element_at(listed, F.greatest("_range", F.lit(1))))
        wraps = F.col("_range") == (0 if has_null else 1)
        places = F.when(F.col("_range") == 0, F.array(own, guest(F.lit(last)))).when(
            F.coalesce(is_first, F.lit(False)) & wraps, F.array(own, guest(F.col("_range") - 1), guest(F.lit(last)))).when(
            is_first, F.array(own, guest(F.col("_range") - 1))).otherwise(F.array(own))
    else:
        places = F.array(own, guest(F.lit(0)))
    placed = rows.withColumn("_place", F.explode(places)).select(
        F.col("_place.range").alias("_range"), F.col("_place.guest").alias("_guest"), "_key", "_text")
    tasks = max(1, 2 * (last + 1))
    sorted_rows = placed.repartition(tasks, "_range").sortWithinPartitions(
        "_range", F.desc("_guest"), F.desc_nulls_last("_key"), F.asc_nulls_first("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        nothing = ("", empty)
        at, current = None, None
        head, follow = nothing, nothing  # first document of the key being read, and of the one after it: a row here or (text, hashes)
        for batch in batches:
            ranges, guests, keys = (batch.column(i).to_pylist() for i in range(3))
            texts = [t or "" for t in batch.column(3).to_pylist()]
            nexts = []
            for row, (part, guest_row, k) in enumerate(zip(ranges, guests, keys)):
                if part != at:
                    at, current, head, follow = part, None, nothing, nothing
                if current != (guest_row, k):
                    current, follow, head = (guest_row, k), head, row
                nexts.append(follow)
            prints = [h for h, _ in fingerprint_all(texts, gram, window)]
            resolved = lambda x: (texts[x], prints[x]) if isinstance(x, int) else x
            others = [resolved(x) for x in nexts]
            head, follow = resolved(head), resolved(follow)
            edited = [t if not len(t) // 4 else t[:len(t) - len(t) // 4] + o[0][:len(t) // 4] for t, o in zip(texts, others)]
            changed = [h for h, _ in fingerprint_all(edited, gram, window)]
            mine = [i for i, g in enumerate(guests) if not g]
            lists = lambda found: pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(found[i]) for i in mine])]).astype(np.int32),
                pa.array(np.concatenate([found[i] for i in mine]) if mine else empty, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column(2).take(pa.array(mine, pa.int64())), pa.array([len(texts[i]) for i in mine], pa.int64()),
                pa.array([edited[i] for i in mine], pa.string()), lists(prints), lists(changed),
                pa.array([likeness(prints[i], changed[i]) for i in mine], pa.float64()),
                pa.array([likeness(prints[i], others[i][1]) for i in mine], pa.float64()),
            ], ["_key", "n_chars", "edited", "prints", "edited_prints", "near_edited", "near_next"])

    return sorted_rows.mapInArrow(
        run, f"_key {kind}, n_chars long, edited string, prints array<long>, edited_prints array<long>, near_edited double, "
        "near_next double").withColumnRenamed("_key", key)
