"""Composition, confidence and agreement audits: aggregations with tiny results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from evenhand.functions.labels import predicted_class
from evenhand.operators.metrics import literal_array, ratio, with_overall
from evenhand.operators.ranking import exact_quantiles, null_safe_join
from evenhand.schemas import OVERALL
from evenhand.session import settle


def class_composition(
    df: DataFrame, stratum: str, label: str, labels: Sequence[str], strata: Sequence[str]
) -> DataFrame:
    """(stratum, class, n, count, pct): listed classes per stratum and overall, zeros kept.

    ``n`` counts all labelled rows of the stratum, also those of unlisted classes.
    """
    cells = df.where(F.col(label).isNotNull()).groupBy(stratum, F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    cells = with_overall(cells, stratum, ["count"], strata)
    frame = (
        df.sparkSession.range(1)
        .select(F.explode(literal_array([*strata, OVERALL])).alias(stratum))
        .select(stratum, F.explode(literal_array(labels)).alias("class"), F.lit(0).cast("bigint").alias("count"))
    )
    full = frame.unionByName(cells).groupBy(stratum, "class").agg(F.sum("count").alias("count"))
    n = F.sum("count").over(Window.partitionBy(stratum))
    return (
        full.withColumn("n", n).where(F.col("class").isin(list(labels)))
        .withColumn("pct", ratio(F.col("count") * 100.0, F.col("n")))
    )


def source_composition(
    df: DataFrame, stratum: str, source: str, strata: Sequence[str], missing: str = "UNKNOWN"
) -> DataFrame:
    """(stratum, source, count, pct) per stratum and overall; a NULL source is named."""
    cells = df.groupBy(stratum, F.coalesce(F.col(source), F.lit(missing)).alias("source")).agg(
        F.count(F.lit(1)).alias("count"))
    cells = with_overall(cells, stratum, ["count"], strata)
    n = F.sum("count").over(Window.partitionBy(stratum))
    return cells.withColumn("pct", ratio(F.col("count") * 100.0, n))


def stratum_audit(
    df: DataFrame, stratum: str, strata: Sequence[str], confidence: str, threshold: float, flag: str, method: str
) -> DataFrame:
    """(section, name, count, pct): totals, methods, kept and filtered per stratum.

    One aggregation over (stratum, method) cells; sections are sums of these.
    """
    kept = F.count_if(F.col(confidence) >= threshold)
    cells = df.groupBy(stratum, method).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("flagged"), kept.alias("kept"),
        F.count_if(F.col(confidence) < threshold).alias("filtered"),
    )
    entries = [("total", F.lit(c), c) for c in ("total", "flagged", "kept", "filtered")]
    entries += [("method", F.col(method), "total"), ("kept", F.col(stratum), "kept"),
                ("filtered", F.col(stratum), "filtered")]
    sections = F.array(*[
        F.struct(F.lit(section).alias("section"), name.alias("name"), F.col(count).alias("count"))
        for section, name, count in entries
    ])
    frame = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(v).alias("name"), F.lit(0).cast("bigint").alias("count"))
        for s in ("kept", "filtered") for v in strata
    ])))
    parts = cells.select(F.inline(sections)).unionByName(frame)
    listed = F.col("section").isin("total", "method") | F.col("name").isin(list(strata))
    sums = parts.where(listed).groupBy("section", "name").agg(F.sum("count").alias("count"))

    def total_of(name: str) -> Column:
        hit = (F.col("section") == "total") & (F.col("name") == name)
        return F.max(F.when(hit, F.col("count"))).over(Window.partitionBy())  # a handful of result rows

    base = F.when(F.col("section") == "kept", total_of("kept")).when(
        F.col("section") == "filtered", total_of("filtered")).otherwise(total_of("total"))
    return sums.withColumn("pct", ratio(F.col("count") * 100.0, base))


def confidence_by_class(df: DataFrame, by: Sequence[str], confidence: str) -> DataFrame:
    """(by, n, mean, std, min, max) with the population standard deviation."""
    c = F.col(confidence)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean_conf"), F.stddev_pop(c).alias("std_conf"),
        F.min(c).alias("min_conf"), F.max(c).alias("max_conf"),
    )


def confidence_by_outcome(df: DataFrame, by: Sequence[str], confidence: str, correct: Column) -> DataFrame:
    """(by, n, mean, mean if right, mean if wrong); an empty side gives 0."""
    c = F.col(confidence)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean_conf"),
        F.coalesce(F.avg(F.when(correct, c)), F.lit(0.0)).alias("correct_conf"),
        F.coalesce(F.avg(F.when(~correct, c)), F.lit(0.0)).alias("incorrect_conf"),
    )


def confidence_histogram(df: DataFrame, by: Sequence[str], confidence: str, bins: int) -> DataFrame:
    """(by, bin, low, high, n): equal bins over the group's own min..max, the last one closed.

    Two passes over the rows: the ranges, then one counted bin per row. Empty bins
    are not listed. A group with one value spans 0.5 to either side. ``by=[]`` is one
    group.
    """
    c = F.col(confidence)
    if not by:
        whole = df.withColumn("_all", F.when(c.isNotNull(), 1))  # not a constant to the optimizer
        return confidence_histogram(whole, ["_all"], confidence, bins).drop("_all")
    spans = df.groupBy(*by).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    single = F.col("_lo") == F.col("_hi")
    spans = spans.withColumns({
        "_lo": F.when(single, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(single, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    })
    width = (F.col("_hi") - F.col("_lo")) / bins
    spans = settle(spans, "spans")
    placed = null_safe_join(df.where(c.isNotNull()).select(*by, c.alias("_v")), spans, by).withColumn(
        "bin", F.least(F.floor((F.col("_v") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1))
    )
    counted = placed.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n",
    )


def prediction_summary(
    df: DataFrame, label: str, labels: Sequence[str], confidence: str
) -> DataFrame:
    """(class, n, pct, mean_conf, median_conf) over listed classes, zeros for absent ones."""
    sums = df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_conf"))
    medians = exact_quantiles(df, [label], confidence, [0.5]).select(
        F.col(label).alias("class"), F.col("quantile").alias("median_conf"))
    frame = df.sparkSession.range(1).select(F.explode(literal_array(labels)).alias("class"))
    total = F.sum("n").over(Window.partitionBy())
    with_share = sums.withColumn("pct", ratio(F.col("n") * 100.0, total))
    full = frame.join(with_share, "class", "left").join(medians, "class", "left")
    zero = F.lit(0.0)
    return full.select(
        "class", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("pct", zero).alias("pct"),
        F.coalesce("mean_conf", zero).alias("mean_conf"), F.coalesce("median_conf", zero).alias("median_conf"),
    )


def low_confidence_share(df: DataFrame, confidence: str, below: float = 0.5) -> DataFrame:
    """(n, n_low, pct_low) of one table."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(confidence) < below).alias("n_low"))
    return counts.withColumn("pct_low", ratio(F.col("n_low") * 100.0, F.col("n")))


def within_one(df: DataFrame, by: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    """(by, n, exact, relaxed): accuracy and accuracy within one step of an ordinal scale."""
    both = df.where(truth.isNotNull() & pred.isNotNull())
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((truth == pred).cast("double")).alias("exact"),
        F.avg((F.abs(truth - pred) <= 1).cast("double")).alias("relaxed"),
    )


def accuracy_breakdown(df: DataFrame, facets: Sequence[str], correct: Column) -> DataFrame:
    """(facet, value, n, accuracy) for several facets in one aggregation."""
    rows = df.groupBy(*facets).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("ok"))
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), F.col("n"), F.col("ok"))
        for f in facets
    ])))
    sums = long.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    return sums.select("facet", "value", "n", ratio(F.col("ok"), F.col("n")).alias("accuracy"))


def either_rater(df: DataFrame, pred: Column, raters: Sequence[Column], confidence: str) -> DataFrame:
    """(n, n_either, mean_conf, conf_either, conf_neither): right by at least one rater."""
    hit = F.lit(False)
    for r in raters:
        hit = hit | F.coalesce(pred == r, F.lit(False))
    c = F.col(confidence)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_either"), F.avg(c).alias("mean_conf"),
        F.avg(F.when(hit, c)).alias("conf_either"), F.avg(F.when(~hit, c)).alias("conf_neither"),
    )


def side_by_side_counts(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(class, one count per column) over listed classes, zeros kept; one pass over the rows.

    Rows are reduced to label combinations before they are unpivoted.
    """
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    long = combos.select(F.inline(F.array(*[
        F.struct(F.col(c).alias("class"), *[
            (F.col("n") if o == c else F.lit(0).cast("bigint")).alias(f"n_{o}") for o in columns
        ]) for c in columns
    ])))
    frame = df.sparkSession.range(1).select(
        F.explode(literal_array(labels)).alias("class"), *[F.lit(0).cast("bigint").alias(f"n_{c}") for c in columns]
    )
    kept = long.where(F.col("class").isin(list(labels)))
    return frame.unionByName(kept).groupBy("class").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in columns])


def row_accounting(df: DataFrame, checks: Mapping[str, Column], distinct: Sequence[str] = ()) -> DataFrame:
    """One row: total, rows passing each check, distinct values of the listed columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(condition).alias(name) for name, condition in checks.items()],
        *[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in distinct],
    )


def write_with_accounting(
    df: DataFrame, path: str, checks: Mapping[str, Column], keep: Column | None = None
) -> dict[str, int]:
    """Write the rows that pass ``keep`` and count in the same pass: n_rows, each check before it, n_kept after it.

    The counts are metrics of the write itself, so the source is read once. NULL checks
    do not count, and a NULL ``keep`` drops the row.
    """
    before, after = Observation("before"), Observation("after")
    seen = df.observe(before, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    kept = seen if keep is None else seen.where(keep)
    kept.observe(after, F.count(F.lit(1)).alias("n_kept")).write.mode("overwrite").parquet(path)
    return {**before.get, **after.get}


def average_views(
    df: DataFrame, item: Sequence[str], probs: str, size: int, classes: Sequence[str]
) -> DataFrame:
    """Mean score vector over the views of an item, its arg-max class and confidence."""
    means = df.groupBy(*item).agg(
        F.count(F.lit(1)).alias("n_views"),
        F.array(*[F.avg(F.get(F.col(probs), F.lit(i))) for i in range(size)]).alias("probs"),
    )
    return means.withColumns({
        "pred_class": predicted_class(F.col("probs"), classes), "confidence": F.array_max("probs"),
    })


def pca_projection(df: DataFrame, item: str, features: str, k: int) -> DataFrame:
    """(item, pca): first ``k`` principal components of an array column.

    Meant for a stratified subsample; the covariance matrix is dims x dims.
    """
    vectors = df.select(item, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    return model.transform(vectors).select(item, vector_to_array("_p").alias("pca"))
