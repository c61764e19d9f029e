"""Mixing sources to target weights by systematic sampling.

A document of a source is expected target / size times in the mix. Documents are
laid one after the other within their source, each as long as its expected copies;
a document is emitted once for every whole number, shifted by one offset of the
source, that falls into its stretch. They are laid in the order of their size
class, so that every stretch of like sizes gets its share and the words taken stay
near the target.

All of it is one small table of cells (source, size class, hash slice) and one pass
over the rows: a source of any share of the rows is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.hashing import hash32, uniform
from evenhand.llm.texts import WORD, sheltered
from evenhand.session import reliable_checkpoint

MOST_COPIES = 3
MADE = ["size", "source_size", "target", "copies", "taken"]
SLICE_ROWS = 50_000  # rows of a hash slice of a size class, about


def word_count(text: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Two classes for every doubling of the size."""
    bits = F.bin(size + 1)
    return F.length(bits) * 2 + F.when(F.substring(bits, 2, 1) == "1", 1).otherwise(0)


def source_targets(sources: DataFrame, weights: Sequence[float], most: int = MOST_COPIES) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size); weights repeat in the order of ``_src``.

    Targets share the sum of all sizes by weight. Every target above ``most`` times its
    size is set to that, and what it leaves is shared among the others, again and again:
    the end of this is one level, found by going through the sources in the order of
    size to weight. The table has one row per source.
    """
    by_name = Window.orderBy("_src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn(
        "_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("_w"), "_src")
    from_here = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    steps = weighed.withColumns({
        "_at": F.row_number().over(by_need),
        "_left": F.sum("source_size").over(whole)
        - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_rest": F.sum("_w").over(from_here),
    })
    free = F.col("_left") * F.col("_w") < F.lit(most) * F.col("source_size") * F.col("_rest")
    level = F.struct(F.col("_at").alias("at"), F.col("_left").alias("left"), F.col("_rest").alias("rest"))
    settled = steps.withColumn("_first", F.min(F.when(free, level)).over(whole))
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first.at"))
    target = F.when(capped, F.lit(most) * F.col("source_size").cast("double")).otherwise(
        F.col("_first.left").cast("double") * F.col("_w") / F.col("_first.rest"))
    return settled.select("_src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), key: str = "doc_id", text: str = "text",
        source: str = "source", seed: int = 42, most: int = MOST_COPIES) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    Sizes are words. Sources weigh ``weights`` in turn, by code point, null last; a null
    source is a source of its own. ``copies`` is how often the row is in the mix: 0 to
    ``most``. Documents of a source lie in the order of their size class, within a class by
    hash slices of about ``SLICE_ROWS`` rows and there by size, so that neighbours are alike
    and the words taken miss the target by little more than one of the longest documents.
    ``copies`` depends on the source, the size, the key and the text only, so reruns agree
    and repeated rows are copied like neighbours; rows that are alike in key and text may
    differ in copies by one. Null or empty texts have size 0 and lie first in their source;
    a source without words has the target 0 and copies 0. A null key is left out of the
    hash. An empty table gives an empty table. Columns of ``docs`` that have the name of a
    result column are replaced, all others keep their values.
    """
    docs = docs.drop(*[c for c in MADE if c not in (key, text, source)])
    docs, restored = sheltered(docs, (key, text, source))
    size = word_count(text)
    rows = docs.withColumns({
        "size": size,
        "_src": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(source).cast("string"))),
        "_hash": hash32(F.col(key), F.col(text), seed=seed),
    }).withColumn("_class", size_class(F.col("size")))
    slices = F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("bigint")
    classes = reliable_checkpoint(rows.groupBy("_src", "_class").agg(slices.alias("_slices")), "classes")
    rows = rows.join(classes, ["_src", "_class"]).withColumn("_slice", F.pmod("_hash", "_slices")).drop("_slices")
    cell = ["_src", "_class", "_slice"]
    cells = reliable_checkpoint(
        rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")), "cells")
    targets = source_targets(cells.groupBy("_src").agg(F.sum("_words").alias("source_size")), weights, most)
    before = Window.partitionBy("_src").orderBy("_class", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(targets, "_src").select(
        *cell, "_before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
        uniform(F.col("_src"), seed=seed).alias("_offset"))
    placed = reliable_checkpoint(placed, "placed")
    inside = Window.partitionBy(*cell).orderBy("size", "_hash", key)
    numbered = rows.withColumn("_at", F.row_number().over(inside)).join(placed, cell)
    start = (F.col("_before") + F.col("_at") - 1) * F.col("_rate") + F.col("_offset")
    end = (F.col("_before") + F.col("_at")) * F.col("_rate") + F.col("_offset")
    copies = F.least(F.floor(end) - F.floor(start), F.lit(most)).cast("int")
    found = numbered.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return restored(found, MADE)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, without the columns that :func:`mix` added."""
    rows = mixed.where(F.col("copies") > 0)
    repeated = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("number of the copy"))
    return repeated.drop("number of the copy", *MADE)


def emit_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), key: str = "doc_id", text: str = "text",
             source: str = "source", seed: int = 42, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with all their own columns, whatever their names."""
    given, restored = sheltered(docs, (key, text, source))
    return restored(emit(mix(given, weights, key, text, source, seed, most)))
