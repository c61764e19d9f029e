"""A file sink that a replayed micro-batch does not double.

Each batch is written into the folder of its number, which it replaces as a whole. A job
that stops between the write and the commit of the batch writes the same folder again.
The stream may transform a batch with joins and aggregates, which the plain file sink
cannot take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "_batch"


def batch_folder(path: str, number: int) -> str:
    """Folder of one batch, named as a partition."""
    return f"{path.rstrip('/')}/{BATCH}={number}"


def run_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    after_write: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Process all files that are there, each micro-batch into its own folder below ``path``, and stop.

    ``transform`` takes and gives plain tables and must give the same rows when it is
    repeated. ``after_write`` is called between the write and the commit. Call the
    function again with the same ``checkpoint`` to continue.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(batch_folder(path, number))
        if after_write is not None:
            after_write(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far; an empty table before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
