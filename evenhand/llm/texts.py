"""Arrow helpers shared by the text operators: bounded batches, words, word counts.

Everything here works on whole texts. A batch is bounded by bytes, never by
cutting a text off: longer texts are split at ASCII white space and their pieces
are put together again by the caller.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GROUP_BYTES = 4 << 20
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: How to drop what a module keeps in a worker from task to task, by the name of the module.
KEEPERS: dict[str, Callable[[], None]] = {}


def spare_memory() -> None:
    """Give what this process has freed back to the system; Spark uses a worker again for other tasks, and most of it stays with it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """``run`` for ``mapInArrow``, begun without what tasks of other modules than ``owner`` have left, and leaving nothing that is free."""

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in KEEPERS.items():
            if name != owner:
                drop()
        spare_memory()
        yield from run(batches)
        spare_memory()

    return run_lean


def bounded_batches(spark: SparkSession, size: int = GROUP_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def with_carried(docs: DataFrame, key: str, text: str, carry: Sequence[str]) -> DataFrame:
    """(_text, _key, c_<name>...): the columns that an Arrow function needs, under names that cannot clash."""
    rest = [F.col(c).alias(f"c_{c}") for c in carry if c not in (key, text)]
    return docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"), *rest)


def sheltered(docs: DataFrame, used: Sequence[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(``docs`` with all columns but ``used`` under names that no operator makes, how to get the columns of ``docs`` back).

    Operators add columns of their own, some of which a table may have already; under
    shelter the table's own values pass through whatever is added.
    """
    own = {c: f"own column {i}" for i, c in enumerate(docs.columns) if c not in used}
    given = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns])

    def restored(found: DataFrame, made: Sequence[str] = ()) -> DataFrame:
        return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns], *made)

    return given, restored


def pass_on(narrow: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list]], made: dict[str, str],
            key: str, text: str, carry: Sequence[str]) -> DataFrame:
    """Map ``narrow`` of :func:`with_carried` batch by batch: key, carried columns, then the columns ``made``.

    ``start`` makes the function of a batch once in each task. A carried column with the
    name of a made one is replaced by it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    carry = [c for c in carry if c not in made]
    names = ["_key"] + [f"c_{c}" for c in carry if c not in (key, text)] + (["_text"] if text in carry else [])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(place[c]) for c in names] + work(batch), names + list(made))

    place = {c: i for i, c in enumerate(narrow.columns)}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{c}` {k}" for c, k in made.items()])
    final = [key] + [c for c in carry if c not in (key, text)] + ([text] if text in carry else []) + list(made)
    return narrow.mapInArrow(lean(mapped), schema).toDF(*final)


def cut_at_spaces(data: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that begin and end between words."""
    start = 0
    while len(data) - start > limit:
        end = start + limit
        while end < len(data) and data[end] not in SPACES:  # a word is never cut, however long
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def byte_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row numbers, texts) in groups of at most ``limit`` bytes; a null text is empty.

    A longer text comes as several pieces, in order, under the same row number. A
    group holds more than ``limit`` bytes only if one word does.
    """
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    total = 0
    for row in range(len(sizes) + 1):
        full = row < len(sizes) and total + sizes[row] > limit
        if (row == len(sizes) or full) and row > begin:
            yield np.arange(begin, row), texts.slice(begin, row - begin)
            begin, total = row, 0
        if row < len(sizes):
            if sizes[row] > limit:
                for piece in cut_at_spaces(texts[row].as_py().encode(), limit):
                    yield np.array([row]), pa.array([piece.decode()])
                begin, total = row + 1, 0
            else:
                total += sizes[row]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each word the position of its text.

    Words are separated by the characters space and U+0009 to U+000D only.
    ``lower`` lower-cases A-Z only.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled, min_count=0).as_py():
        words, rows = words.filter(filled), rows[filled.to_numpy(zero_copy_only=False)]
    return words, rows


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, position of each word's text)."""
    words, rows = split_words(texts, lower)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), rows


def word_counts(texts: DataFrame, text: str = "text", lower: bool = False) -> DataFrame:
    """(word, n): how often each word occurs in all texts, counted per batch before the shuffle."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in byte_groups(batch.column(0)):
                words, codes, _ = coded_words(group, lower)
                n = np.bincount(codes, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(lean(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(ends[-1])
    return values[at]
