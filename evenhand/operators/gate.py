"""Text gate: five checks, reasons, report, scores and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions import text as tx
from evenhand.functions.text import Lexicon
from evenhand.operators.metrics import literal_array, ratio
from evenhand.operators.ranking import exact_quantiles
from evenhand.session import settle

CHECKS = ["keywords", "indeterminate", "spatial", "length", "safety"]
# Reason per check in gate order, and the weight of each check.
REASONS = {"keywords": "keyword_fail", "indeterminate": "indeterminate", "spatial": "spatial_misalign",
           "length": "length_fail", "safety": "safety_fail"}
WEIGHTS = {"keywords": "0.30", "indeterminate": "0.10", "spatial": "0.25", "length": "0.10", "safety": "0.25"}


def run_checks(
    df: DataFrame, lexicon: Lexicon = Lexicon(), text: str = "teacher_reasoning", label: str = "predicted_class",
    focus: str | None = "gradcam_spatial_region", listed: str | None = None,
) -> DataFrame:
    """Add check results: ``pass_<check>`` columns and their details.

    ``listed`` names a column with explicit keywords, which wins over the class
    list where it is not NULL. A NULL text is checked as an empty one. Row-wise: also
    runs on a stream.
    """
    region = F.col(focus) if focus is not None else F.lit(None).cast("string")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({"_low": F.lower(whole), "_focus": region})
    low = F.col("_low")
    by_class = tx.matched_keywords(low, F.col(label), lexicon)
    expected = tx.expected_keywords(F.col(label), lexicon)
    if listed is not None:
        by_class = F.coalesce(tx.matched_listed_keywords(low, F.col(listed)), by_class)
        expected = F.coalesce(F.col(listed), expected)
    rows = rows.withColumns({
        "keywords_matched": by_class,
        "keywords_expected": expected,
        "reject_phrase": tx.first_phrase(low, lexicon.reject, lexicon.word_boundary),
        "text_regions": tx.named_regions(low, lexicon),
        "region_conflicts": tx.region_conflicts(low, F.col("_focus"), lexicon),
        "word_count": tx.word_count(whole),
        "safety_problem": tx.safety_problem(low, lexicon),
    })
    rows = rows.withColumn(
        "spatial_status", tx.spatial_status(F.col("region_conflicts"), F.col("text_regions"), F.col("_focus")))
    return rows.withColumns({
        "pass_keywords": F.size("keywords_matched") >= lexicon.min_keywords,
        "pass_indeterminate": F.col("reject_phrase").isNull(),
        "pass_spatial": F.size("region_conflicts") == 0,
        "pass_length": F.col("word_count").between(lexicon.min_words, lexicon.max_words),
        "pass_safety": F.col("safety_problem").isNull(),
    }).drop("_low", "_focus")


def gate(checked: DataFrame) -> DataFrame:
    """Add ``reason`` (first failed check, NULL if kept), ``detail`` and ``qc_metadata``."""
    reason = F.coalesce(*[F.when(~F.col(f"pass_{c}"), F.lit(REASONS[c])) for c in CHECKS])
    detail = (
        F.when(F.col("reason") == "keyword_fail", F.concat_ws(
            "; ", F.concat(F.lit("matched "), F.concat_ws(",", "keywords_matched")),
            F.concat(F.lit("expected "), F.concat_ws(",", "keywords_expected"))))
        .when(F.col("reason") == "indeterminate", F.col("reject_phrase"))
        .when(F.col("reason") == "spatial_misalign", F.col("spatial_status"))
        .when(F.col("reason") == "length_fail", F.col("word_count").cast("string"))
        .when(F.col("reason") == "safety_fail", F.col("safety_problem"))
    )
    metadata = F.when(F.col("reason").isNull(), F.struct("keywords_matched", "spatial_status", "word_count"))
    return checked.withColumn("reason", reason).withColumns({"detail": detail, "qc_metadata": metadata})


def gate_report(gated: DataFrame, label: str = "predicted_class", minimum: int = 1500) -> DataFrame:
    """(section, name, count, share): totals, discards per reason, kept per class, minimum met.

    One aggregation over (reason, class) cells.
    """
    cells = gated.groupBy("reason", F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("reason").isNull()
    zero = F.lit(0).cast("bigint")
    entries = [
        (F.lit("total"), F.lit("input"), F.col("n")),
        (F.lit("total"), F.lit("clean"), F.when(kept, F.col("n")).otherwise(zero)),
        (F.lit("total"), F.lit("discarded"), F.when(kept, zero).otherwise(F.col("n"))),
        (F.lit("threshold"), F.lit("meets_minimum"), F.when(kept, F.col("n")).otherwise(zero)),
        (F.when(kept, F.lit("class")).otherwise(F.lit("reason")),
         F.when(kept, F.col("_class")).otherwise(F.col("reason")), F.col("n")),
    ]
    rows = F.array(*[
        F.struct(section.alias("section"), name.alias("name"), count.alias("count")) for section, name, count in entries
    ])
    frame = gated.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(v).alias("name"), zero.alias("count"))
        for s, v in [("total", "input"), ("total", "clean"), ("total", "discarded"), ("threshold", "meets_minimum"),
                     *[("reason", r) for r in REASONS.values()]]
    ])))
    sums = cells.select(F.inline(rows)).unionByName(frame).groupBy("section", "name").agg(
        F.sum("count").alias("count"))
    total = F.max(F.when(F.col("name") == "input", F.col("count"))).over(Window.partitionBy())  # a few result rows
    flag = F.col("section") == "threshold"
    return sums.select(
        "section", "name", F.when(flag, (F.col("count") >= minimum).cast("bigint")).otherwise(F.col("count")).alias("count"),
        F.when(~flag, ratio(F.col("count"), F.greatest(total, F.lit(1)))).alias("share"),
    )


def response_score(float_scores: bool = False) -> Column:
    """Weighted sum of the passed checks.

    Decimals keep the stated gap rule exact; ``float_scores`` adds doubles in
    check order, where 1.0 - 0.8 falls just short of 0.2.
    """
    kind = "double" if float_scores else "decimal(3,2)"
    total = F.lit(0).cast(kind)
    for check in CHECKS:
        weight = F.lit(WEIGHTS[check]).cast(kind)
        total = (total + F.when(F.col(f"pass_{check}"), weight).otherwise(F.lit(0).cast(kind))).cast(kind)
    return total


def passes_all() -> Column:
    return F.lit(True) & F.col("pass_keywords") & F.col("pass_indeterminate") & F.col("pass_spatial") \
        & F.col("pass_length") & F.col("pass_safety")


def checks_passed() -> Column:
    return sum((F.col(f"pass_{c}").cast("int") for c in CHECKS), F.lit(0))


def score_details() -> Column:
    """Per-check details of a scored text."""
    return F.struct(
        F.struct(F.col("pass_keywords").alias("pass"), F.size("keywords_matched").alias("matched")).alias("keywords"),
        F.struct(F.col("pass_indeterminate").alias("pass")).alias("indeterminate"),
        F.struct(F.col("pass_spatial").alias("pass"), F.col("spatial_status").alias("reason")).alias("spatial"),
        F.struct(F.col("pass_length").alias("pass"), F.col("word_count")).alias("length"),
        F.struct(F.col("pass_safety").alias("pass"), F.coalesce(
            "safety_problem", F.lit(tx.APPROPRIATE)).alias("reason")).alias("safety"),
    )


def pass_rates(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, pass rate per check and overall, mean and interpolated median words).

    Texts are read once, into cells per word count; rates, mean and median all come
    from the cells.
    """
    flags = {"overall": passes_all(), **{c: F.col(f"pass_{c}") for c in CHECKS}}
    cells = settle(checked.groupBy(*by, "word_count").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(c) for c, f in flags.items()]), "word-cells")
    total = F.sum("n")
    sums = cells.groupBy(*by).agg(
        total.alias("n"), *[(F.sum(c) / total).alias(f"{c}_rate") for c in flags],
        (F.sum(F.col("word_count") * F.col("n")) / total).alias("mean_words"),
    )
    medians = exact_quantiles(cells.select(*by, "word_count", "n"), by, "word_count", [0.5], weight="n").select(
        *by, F.col("quantile").alias("median_words"))
    if not by:
        return sums.withColumn("median_words", medians.select("median_words").scalar())
    return sums.join(medians, list(by), "left")


def class_pass_rates(checked: DataFrame, label: str = "predicted_class") -> DataFrame:
    """(class, n, passed, rate)."""
    sums = checked.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passes_all()).alias("passed"))
    return sums.withColumn("rate", ratio(F.col("passed"), F.col("n")))


def head_to_head(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(outcome, n, share): which side passes more checks on the same item, ties included."""
    left = a.select(*keys, checks_passed().alias("_a"))
    right = b.select(*keys, checks_passed().alias("_b"))
    outcome = F.when(F.col("_a") > F.col("_b"), names[0]).when(F.col("_b") > F.col("_a"), names[1]).otherwise("tie")
    counts = left.join(right, list(keys)).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    frame = a.sparkSession.range(1).select(
        F.explode(literal_array([*names, "tie"])).alias("outcome"), F.lit(0).cast("bigint").alias("n"))
    full = frame.unionByName(counts).groupBy("outcome").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return full.withColumn("share", ratio(F.col("n"), total))
