"""Near-duplicate texts by SimHash, with an exact check of every link; minimum hashes reach further pairs.

Every text gets the SimHash fingerprint of its five-word shingles. Fingerprints that
differ in ``RADIUS`` bits or fewer are linked by :func:`simhash.near_links`, which loses
none, and the components of these links are groups of candidates. At a Jaccard similarity
of 0.8 some 10 bits differ, and no block keys for such a radius tell texts apart, so
candidates are also what share a band of minimum hashes: a pair at the threshold shares
none with probability (1 - 0.8 ** ROWS) ** BANDS, about 5 in a million, closer pairs with
less. Groups of candidates of either kind are shipped to the tasks once (large groups in
pairs of chunks), and there all pairs are compared by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.components import components
from evenhand.llm.simhash import classes_of, majority, near_links, roots_of
from evenhand.llm.texts import bounded_batches, pass_on, with_carried
from evenhand.session import reliable_checkpoint

WORDS = 5
SIMILAR = 0.8
RADIUS, BLOCKS = 3, 5  # differing bits of fingerprints that link; blocks of bits, of which linked ones share two
BANDS, ROWS = 40, 6
CHUNK = 512  # texts of one group that are compared in one place; larger groups are cut into chunks
CHUNK_SHINGLES = 1 << 20  # the same in shingles
SLOT_SHINGLES = 2 << 20  # shingles of a task
COLUMNS = 4_096  # shingles that are compared at a time
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
FACTORS |= np.uint32(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles in rising order; the whole text if it is shorter. Lower-cases A-Z only."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[found[i:] for i in range(words)])) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), np.uint64))


def set_print(shingles: np.ndarray) -> int:
    """Equal for equal sets; 0 for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42) if len(shingles) else 0


def band_keys(sets: list[np.ndarray], bands: int = BANDS) -> np.ndarray:
    """[sets, bands]: a key of the ``ROWS`` minimum hashes of each band; no set may be empty."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(values * FACTORS[i] + SHIFTS[i], starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def set_prints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
               carry: Sequence[str] = (), name: str = "bits", banded: bool = False, bands: int = BANDS) -> DataFrame:
    """(key, carry..., ``name``): the print of each text's shingle set.

    ``banded`` adds the set's size, its SimHash fingerprint and its keys of ``bands`` bands.
    """
    bounded_batches(docs.sparkSession)

    def start():
        def run(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            made = [pa.array(np.array([set_print(s) for s in sets], np.uint64).view(np.int64))]
            if banded:
                filled = [s for s in sets if len(s)]
                keys = band_keys(filled, bands) if filled else np.zeros((0, bands), np.uint64)
                offsets = np.r_[0, np.cumsum([bands * (len(s) > 0) for s in sets])].astype(np.int32)
                made += [pa.array(np.array([len(s) for s in sets], np.int64)),
                         pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))]
            return made

        return run

    made = {name: "long"} | ({"size": "long", "simhash": "long", "parts": "array<long>"} if banded else {})
    return pass_on(with_carried(docs, key, text, carry), start, made, key, text, carry)


def distinct_texts(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(bits, text): each shingle set of a task with the first text that has it."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            prints = [set_print(shingle_set(t.as_py(), words)) for t in batch.column(0)]
            new = []
            for row, bits in enumerate(prints):
                if bits not in seen:
                    seen.add(bits)
                    new.append(row)
            bits = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([bits.take(pa.array(new, pa.int64())),
                                              batch.column(0).take(pa.array(new, pa.int64()))], ["bits", "text"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bits long, text string")


def similar_pairs(sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all sets whose Jaccard similarity is at least ``similar``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[code] > 1
    owner, code = owner[shared], (np.cumsum(n > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)))
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        part = slice(*np.searchsorted(code, [first, first + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, int(code[-1]) + 1 - first)), np.float32)
        held[owner[part], code[part] - first] = 1
        common += held @ held.T
    both = sizes[:, None] + sizes[None, :]
    return np.nonzero(np.triu(common * (1 + similar) >= similar * both - 1e-6, 1))


def print_keys(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bits, part): one key for all sets of ``classes`` (bits, size, simhash) whose fingerprints links of the radius join."""
    filled = classes.where(F.col("size") > 0)
    roots = components(near_links(filled.select(F.col("simhash").alias("bits")).distinct(), radius, BLOCKS))
    rooted = filled.join(roots, F.col("simhash") == F.col("node"), "left")
    return rooted.select("bits", F.xxhash64(F.lit("simhash"), F.coalesce("root", "simhash")).alias("part"))


def copy_links(docs: DataFrame, classes: DataFrame, keyed: DataFrame, text: str, words: int, similar: float) -> DataFrame:
    """Links (a, b) that join all candidates whose similarity is at least ``similar``.

    ``classes`` is (bits, size, ...) of distinct sets, ``keyed`` their (bits, part).
    """
    shared = keyed.groupBy("part").agg(F.min("bits").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    stars = keyed.join(shared, "part").where(F.col("bits") != F.col("least")).select(
        F.col("bits").alias("a"), F.col("least").alias("b"))
    groups = components(stars)
    members = reliable_checkpoint(groups.select(F.col("node").alias("bits"), F.col("root").alias("cluster")).join(
        classes.select("bits", "size"), "bits"), "members")
    chunked = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    placed = reliable_checkpoint(members.join(chunked, "cluster").select("bits", "size", "cluster", "chunks", own.alias("own")), "placed")
    slots = max(6, -(-(placed.agg(F.sum(F.col("size") * F.col("chunks"))).first()[0] or 0) // SLOT_SHINGLES))
    texts = reliable_checkpoint(
        distinct_texts(docs, text, words).join(placed, "bits").dropDuplicates(["bits"]), "texts")
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits", "text")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(slots)).cast("int"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", "low", "high", "bits")])
        bits, texts = table["bits"].to_numpy(), table["text"]
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cluster", "low", "high")])
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            pairs = similar_pairs([shingle_set(texts[int(i)].as_py(), words) for i in range(begin, end)], similar)
            root = roots_of(end - begin, iter([pairs]))
            linked = np.flatnonzero(root != np.arange(end - begin))
            a.append(bits[begin + linked])
            b.append(bits[begin + root[linked]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("slot").applyInArrow(link, "a long, b long")


def copy_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                 similar: float = SIMILAR, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """(key, fingerprint, component_id, root) for every row of ``docs``, as ``simhash.near_classes`` has them.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``similar``; a shorter text is one shingle, null and empty texts are equal.
    Compared are texts that SimHash fingerprints within ``radius`` bits join and texts
    that share one of ``bands`` bands. The ``fingerprint`` is that of the whole set. Null keys, repeated rows and empty tables are
    treated as in ``near_classes``.
    """
    banded = reliable_checkpoint(set_prints(docs, key, text, words, banded=True, bands=bands), "banded")
    rows = banded.select(key, "bits")
    classes = reliable_checkpoint(banded.groupBy("bits").agg(F.min(key).alias("least"), F.max("size").alias("size"), F.max("simhash").alias("simhash")), "classes")
    shared_bands = banded.select("bits", F.explode("parts").alias("part")).distinct()
    keyed = reliable_checkpoint(shared_bands.union(print_keys(classes, radius)), "keyed")
    return classes_of(rows, classes, copy_links(docs, classes, keyed, text, words, similar), key)
