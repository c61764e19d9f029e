"""Near-duplicates by SimHash fingerprints, compared in bit slices.

Distinct fingerprints that may lie within the radius share a key made of some of
their blocks of bits (pigeonhole, so no pair is lost). The fingerprints of a key are
stored vertically: plane b holds bit b of 64 candidates in one word. A query walks
the planes; a carry-save counter of bitwise operations adds up 64 distances at
once, and words in which every distance exceeds the radius are dropped on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.components import components
from evenhand.llm.texts import bounded_batches, pass_on, sheltered, with_carried
from evenhand.session import reliable_checkpoint

BITS = 64
CHUNK = 2_048  # fingerprints of one key that are compared in one place; keys with more are cut into chunks
SLOT_ROWS = 100_000  # rows of a task
PAIRS = 1 << 18  # (query, word) pairs that are compared at a time


# --- fingerprints ------------------------------------------------------------


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of all shingles' hashes; 0 without words. Lower-cases A-Z only."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return majority(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - shingle + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                 carry: Sequence[str] = (), name: str = "bits") -> DataFrame:
    """(key, carry..., ``name``): the fingerprint of every whole text as a signed long; a null text is empty."""
    bounded_batches(docs.sparkSession)

    def start():
        def run(batch: pa.RecordBatch) -> list:
            bits = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column(0)), np.uint64, batch.num_rows)
            return [pa.array(bits.view(np.int64))]

        return run

    return pass_on(with_carried(docs, key, text, carry), start, {name: "long"}, key, text, carry)


# --- bit slices --------------------------------------------------------------


def planes_of(values: np.ndarray) -> np.ndarray:
    """[64, words]: word w of plane b holds bit b of the values 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(values) // BITS) * BITS, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair number, mask) of the pairs (query value, word) in which some candidate is within the radius.

    The counter has one word per binary digit of ``radius`` and one for overflow.
    Every eight planes the pairs in which all 64 candidates exceed it are abandoned.
    """
    live = np.arange(len(queries))
    digits = [np.zeros(len(queries), np.uint64) for _ in range(max(radius.bit_length(), 1))]
    over = np.zeros(len(queries), np.uint64)
    q, w = queries, words
    for b in range(BITS):
        flip = (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        carry = planes[b, w] ^ flip
        for digit in digits:
            carry, digit[:] = digit & carry, digit ^ carry
        over |= carry
        if b % 8 == 7:
            beyond, equal = over.copy(), ~over
            for i in range(len(digits) - 1, -1, -1):  # counter > radius, digit by digit from the top
                if radius >> i & 1:
                    equal &= digits[i]
                else:
                    beyond |= equal & digits[i]
                    equal &= ~digits[i]
            near = ~beyond
            keep = near != 0
            live, q, w, over, near = live[keep], q[keep], w[keep], over[keep], near[keep]
            digits = [d[keep] for d in digits]
    return live, near


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position linked to each position, pairs coming in blocks."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while (root[root] != root).any():
                root = root[root]
    return root


def near_pairs(values: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of values within the radius; ``ends[i]`` is where the bucket of value i ends.

    Each value is compared with the words that hold later values of its bucket. Other
    values in these words are no harm: what is within the radius is a link.
    """
    planes = planes_of(values)
    first = (np.arange(len(values)) + 1) // BITS
    count = np.where(ends > np.arange(len(values)) + 1, (ends - 1) // BITS - first + 1, 0)
    steps = np.cumsum(count)
    begin = 0
    while begin < len(values):
        stop = max(begin + 1, int(np.searchsorted(steps, (steps[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:stop]
        at = np.repeat(np.arange(begin, stop), n)
        word = np.repeat(first[begin:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(at):
            live, near = within(planes, values[at], word, radius)
            lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            i, j = at[live[row]], word[live[row]] * BITS + lane
            real = (j > i) & (j < len(values))
            yield i[real], j[real]
        begin = stop


# --- links and classes -------------------------------------------------------


def block_keys(radius: int, blocks: int) -> list:
    """One (number, key) struct for each choice of blocks - radius blocks: two values within the radius share one."""
    width = -(-BITS // blocks)
    masks = [sum(1 << b for b in range(i * width, min((i + 1) * width, BITS))) for i in range(blocks)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [F.struct(F.lit(n).alias("number"), F.col("bits").bitwiseAND(F.lit(signed(sum(chosen)))).alias("part"))
            for n, chosen in enumerate(combinations(masks, blocks - radius))]


def near_links(distinct: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that join all values of ``bits`` within the radius; distinct values, no nulls.

    Not every pair is listed: each task returns one link per value to the smallest one
    that its pairs reach. Keys of more than ``CHUNK`` values are cut into chunks, and
    each pair of chunks is a bucket of its own.
    """
    keyed = reliable_checkpoint(distinct.select("bits", F.inline(F.array(*block_keys(radius, blocks)))), "keyed")
    shared = keyed.groupBy("number", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        "number", "part", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = keyed.join(shared, ["number", "part"]).select("*", own.alias("own")).select("*", other.alias("other"))
    rows = reliable_checkpoint(rows.select(
        "number", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits"), "buckets")
    slots = max(1, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("number", "part", "low", "high"), F.lit(max(slots, 6))).cast("int"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("number", "part", "low", "high", "bits")])
        values = table["bits"].combine_chunks().to_numpy().view(np.uint64)
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("number", "part", "low", "high")])
        new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        ends = np.repeat(np.r_[new[1:], len(values)], np.diff(np.r_[new, len(values)]))
        root = roots_of(len(values), near_pairs(values, ends, radius))
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[linked].view(np.int64), "b": values[root[linked]].view(np.int64)})

    return rows.groupBy("slot").applyInArrow(link, "a long, b long")


def classes_of(rows: DataFrame, classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint, component_id, root) of ``rows`` (key, bits), whose ``classes`` (bits, least) are linked."""
    roots = components(links)
    rooted = classes.join(roots, classes["bits"] == roots["node"], "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("bits", "component_id", "root")
    return rows.join(named, "bits").select(
        key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "root")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                 blocks: int = 4) -> DataFrame:
    """(key, fingerprint, component_id, root) for every row of ``docs``.

    Fingerprints with at most ``radius`` differing bits are linked; ``component_id`` is
    the smallest key that links reach, the row's own included. Null keys are passed
    over there, and are null where a component has no other. Null and empty texts have
    the fingerprint 0, which links like any other. Rows of one fingerprint are one
    class, however many, and only classes are compared. Repeated rows each get a row;
    an empty table gives an empty table; other columns are not read.
    """
    rows = reliable_checkpoint(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = reliable_checkpoint(rows.groupBy("bits").agg(F.min(key).alias("least")), "classes")
    return classes_of(rows, classes, near_links(classes.select("bits"), radius, blocks), key)


def keep_first(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
               prints: Callable[..., DataFrame] = fingerprints) -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_classes`: that of the smallest key, the rest is dropped.

    ``prints`` is what made the fingerprints of ``classes``.

    Rows that repeat this key are reduced to one. A row without a key stays only if no
    row of its component has one, and one of such rows stays.
    """
    docs, restored = sheltered(docs, (key, text))
    kept = classes.where(F.col(key) == F.col("component_id")).select(key).distinct()
    keyed = docs.join(kept, key, "left_semi").dropDuplicates([key])  # one shuffle serves both
    lone = classes.where(F.col(key).isNull() & F.col("component_id").isNull()).select(
        F.conv("fingerprint", 16, -10).cast("long").alias("_bits"), F.col("root").alias("_root")).distinct()
    nameless = prints(docs.where(F.col(key).isNull()), key, text, shingle, docs.columns, "_bits")
    rest = nameless.join(lone, "_bits").dropDuplicates(["_root"])
    return restored(keyed.select(*docs.columns).unionByName(rest.select(*docs.columns)))
