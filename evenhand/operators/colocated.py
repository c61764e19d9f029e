"""Tables written in buckets of their item, so that joins and groups on it need no shuffle.

Truth, strata and predictions are joined on the item again and again, by every audit.
Written once in the same number of buckets, they meet bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenhand.session import new_work_path

BUCKET_ROWS = 2_000_000  # rows of the longest of the tables that a task sorts and joins at a time


def bucket_count(rows: int, least: int = 8) -> int:
    """Buckets for tables of which the longest has ``rows`` rows: a bucket is read by one task, so it must not grow."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_colocated(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``name`` in ``buckets`` buckets of ``key``, sorted by it, and return the table.

    Rows are dealt out by the key before they are written, so a bucket is one file. Take
    as many buckets as :func:`bucket_count` gives; tables that are to be joined need the
    same number. A key that holds a large share of the rows makes one large
    bucket: such tables are better joined without buckets, where a skewed key is split.
    """
    spark = df.sparkSession
    target = path or new_work_path(spark, name)
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", target).saveAsTable(name)
    return spark.table(name)


def shuffles_on(df: DataFrame, key: str) -> int:
    """Number of exchanges by ``key`` in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and f"({key}#" in line for line in plan.splitlines())


def drop_colocated(spark: SparkSession, *names: str) -> None:
    """Forget the tables; their files are left for the folder's own clean-up."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
