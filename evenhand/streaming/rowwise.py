"""Row-wise operators on a stream: the resumable form of a long per-record job.

The text checks, scores and label expressions hold no window, aggregate or join,
so they accept a streaming table as they are. A file stream with a checkpoint
folder replaces a job that saves its progress every few records: files that were
finished are not read again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def read_record_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "json", files_per_trigger: int = 100
) -> DataFrame:
    """New files below ``path`` as a stream."""
    return (
        spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def run_until_done(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Process all files that are there, append to Parquet exactly once, and stop.

    Call it again with the same ``checkpoint`` to continue.
    """
    query = (
        transform(stream).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
