"""JSON arrays of any size, read by many tasks.

The file is read as text that is cut at every ``}``, which Spark's text source does in
byte ranges of one file. Whether a byte lies inside a string, and how deep it is nested,
depends on everything before it, so each piece of a range is first summed up for both
cases: how it changes the state and how far up it comes. Prefix sums over these
summaries, a few numbers for each megabyte, give the true state at the start of every
piece. With it each piece finds the borders of its records by itself; only a record that
lies across pieces is put together from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from evenhand.session import reliable_checkpoint, settle

PIECE_BYTES = 1 << 20
TASK_BYTES = 16 << 20  # a task reads so many splits one after the other that it has about as much
QUOTE, BACKSLASH = ord('"'), ord("\\")
NUMBERS = ["flips", "sum_out", "sum_in", "low_out", "low_in"]


def nesting(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte has an odd number of string borders up to it, change of depth if it is outside of strings)."""
    chars = np.frombuffer(data, np.uint8)
    quote = chars == QUOTE
    back = chars == BACKSLASH
    if back.any():
        at = np.arange(len(chars))
        other = np.maximum.accumulate(np.where(back, -1, at))  # the last byte that is no backslash
        before = np.append(-1, other[:-1])
        quote &= (at - 1 - before) % 2 == 0
    odd = (np.cumsum(quote) & 1).astype(bool)
    step = np.zeros(len(chars), np.int64)
    step[(chars == ord("{")) | (chars == ord("["))] = 1
    step[(chars == ord("}")) | (chars == ord("]"))] = -1
    return odd, step


def summary(data: bytes) -> list[int]:
    """Parity of string borders; sum and least running sum of the depth, started outside and inside of a string."""
    odd, step = nesting(data)
    outside, inside = np.cumsum(np.where(odd, 0, step)), np.cumsum(np.where(odd, step, 0))
    return [int(odd[-1]), int(outside[-1]), int(inside[-1]), min(0, int(outside.min())), min(0, int(inside.min()))]


def task_count(splits: int, split_bytes: int, least: int) -> int:
    """Tasks for ``splits`` splits: one each up to ``least``, then as many as ``TASK_BYTES`` asks for."""
    return max(1, min(splits, max(least, -(-splits * split_bytes // TASK_BYTES))))


def text_pieces(spark: SparkSession, path: str, split_bytes: int | None, piece_bytes: int) -> DataFrame:
    """(path, start, seq, data, is_array, summary) of all files, written once.

    ``is_array`` is set in the first piece of a file only.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, parts, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            data = b"}".join(parts) + b"}"
            head = data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1] == b"[" if at[1] == 0 and seq == 0 else None
            values = [at[0], at[1], seq, data, head, *summary(data)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        for batch in batches:
            for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != at or size >= piece_bytes:
                    if parts:
                        yield piece()
                    seq = seq + 1 if (file, start) == at else 0
                    at, parts, size = (file, start), [], 0
                parts.append(value)
                size += len(value) + 1
        if parts:
            yield piece()

    names = ["path", "start", "seq", "data", "is_array", *NUMBERS]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()] + [pa.int64()] * len(NUMBERS)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    if split_bytes is not None:
        spark.conf.set(setting, str(split_bytes))
    try:
        lines = spark.read.option("lineSep", "}").text(path).select(
            F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"))
        if split_bytes is not None:
            lines = lines.coalesce(task_count(lines.rdd.getNumPartitions(), split_bytes, spark.sparkContext.defaultParallelism))
        return reliable_checkpoint(lines.mapInArrow(
            gathered, "path string, start long, seq long, data binary, is_array boolean, " + ", ".join(f"{n} long" for n in NUMBERS)),
            "json-pieces")
    finally:
        spark.conf.set(setting, before)


def start_states(pieces: DataFrame) -> DataFrame:
    """(path, start, seq, in_string, depth, base, from_start, from_seq): the state in which each piece begins.

    Records lie at depth ``base``: 1 in an array, 0 in a file of objects one after the
    other. ``from_start`` and ``from_seq`` name the piece in which the record begins that
    goes on in this one. Only the summaries are read; a file has one for each piece.
    """
    along = Window.partitionBy("path").orderBy("start", "seq")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1
    known = pieces.select("path", "start", "seq", "is_array", *NUMBERS).withColumn("in_string", inside)
    known = known.withColumns({
        "change": F.when(F.col("in_string"), F.col("sum_in")).otherwise(F.col("sum_out")),
        "low": F.when(F.col("in_string"), F.col("low_in")).otherwise(F.col("low_out")),
        "base": F.first("is_array", ignorenulls=True).over(so_far).cast("int"),
    }).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    opens = (F.col("depth") + F.col("change") > F.col("base")) & (F.col("depth") + F.col("low") <= F.col("base"))
    begun = F.last(F.when(opens, F.struct("start", "seq")), ignorenulls=True).over(before)
    goes_on = F.col("depth") > F.col("base")
    return known.withColumn("begun", F.when(goes_on, begun)).select(
        "path", "start", "seq", "in_string", "depth", "base",
        F.col("begun.start").alias("from_start"), F.col("begun.seq").alias("from_seq"))


def cut_records(data: bytes, in_string: bool, depth: int, base: int) -> tuple[bytes | None, list[bytes], bytes | None]:
    """(rest of a record begun before, whole records, start of a record that goes on)."""
    odd, step = nesting(data)
    step = np.where(odd != in_string, 0, step)
    level = depth + np.cumsum(step)
    first, head = 0, None
    if depth > base:
        ended = np.flatnonzero(level == base)
        if not len(ended):
            return data, [], None
        first = int(ended[0]) + 1
        head = data[:first]
    chars = np.frombuffer(data, np.uint8)
    opened = np.flatnonzero((step == 1) & (level == base + 1) & (chars == ord("{")))
    closed = np.flatnonzero((step == -1) & (level == base) & (chars == ord("}")))
    opened, closed = opened[opened >= first], closed[closed >= first]
    whole = [data[a:z + 1] for a, z in zip(opened.tolist(), closed.tolist())]
    return head, whole, data[int(opened[-1]):] if len(opened) > len(closed) else None


def json_texts(pieces: DataFrame) -> DataFrame:
    """(text): one row for each record."""
    states = settle(start_states(pieces), "json-states")
    at = ["path", "start", "seq"]
    ready = pieces.select(*at, "data").join(states, at).select(
        *at, "data", "in_string", "depth", "base", "from_start", "from_seq")

    def found(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    head, records, tail = cut_records(row["data"], row["in_string"], row["depth"], row["base"])
                    own = (row["path"], row["start"], row["seq"])
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in records], pa.string())], ["text"])
                        continue
                    parts = [((row["from_start"], row["from_seq"]), head)] if head is not None else []
                    parts += [(own[1:], tail)] if tail is not None else []
                    columns = [[own[0]] * len(parts), [p[0][0] for p in parts], [p[0][1] for p in parts],
                               [own[1]] * len(parts), [own[2]] * len(parts), [p[1].decode() for p in parts]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4, pa.string()])],
                        ["path", "from_start", "from_seq", "start", "seq", "text"])

        return run

    across = ready.mapInArrow(found(False), "path string, from_start long, from_seq long, start long, seq long, text string")
    joined = across.groupBy("path", "from_start", "from_seq").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))), lambda p: p["text"])).alias("text"))
    return ready.mapInArrow(found(True), "text string").union(joined.where(F.col("text").startswith("{")).select("text"))


def read_json_pieces(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int | None = None,
                     piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Records of JSON files by ``schema``: an array of objects, or objects one after the other.

    A file is cut into splits of ``split_bytes`` (default: the session's), which are read
    by tasks of their own or, if they are many, some in one task (:func:`task_count`). Its records are parsed by tasks of about ``piece_bytes`` and more. The
    order of records is not kept. A record that does not fit the schema has NULLs, as in
    Spark's own reader; elements that are no objects are left out; an empty array or file
    has no rows. The text is written once to the shared folder; a single record must fit
    a task. Files in a compression that cannot be split are one task in the first pass only.
    """
    texts = json_texts(text_pieces(spark, path, split_bytes, piece_bytes))
    return texts.select(F.from_json("text", schema).alias("_r")).select(
        *[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields])
