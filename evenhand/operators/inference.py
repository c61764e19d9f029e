"""Uncertainty and paired tests: bootstrap intervals, McNemar, stricter subsets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from evenhand.functions.draws import multinomial_counts
from evenhand.functions.hashing import SEED, hash32, md5_words
from evenhand.operators.metrics import PRED, TRUE, average_scores, class_scores, confusion_cells, with_overall
from evenhand.operators.ranking import null_safe_join
from evenhand.schemas import OVERALL

DRAW_BLOCK = 100  # draws that a task takes at a time


# --- bootstrap ---------------------------------------------------------------

def _macro_f1(counts: np.ndarray, truth: np.ndarray, pred: np.ndarray, classes: Sequence[str]) -> np.ndarray:
    """Macro F1 of each draw; ``counts`` is draws x cells."""
    scores = []
    for c in classes:
        total = counts[:, truth == c].sum(axis=1) + counts[:, pred == c].sum(axis=1)
        hits = counts[:, (truth == c) & (pred == c)].sum(axis=1)
        scores.append(np.divide(2.0 * hits, total, out=np.zeros(len(counts)), where=total > 0))
    return np.mean(scores, axis=0)


def bootstrap_draws(
    cells: DataFrame, by: Sequence[str], labels: Sequence[str], draws: int = 1000, seed: int = SEED,
) -> DataFrame:
    """(by, draw, n, macro_f1) from confusion cells; draw -1 is the point estimate.

    A draw of N rows with replacement has cell counts that are multinomial
    (N, n_cell / N), so its cost does not depend on N. The counts come cell by cell, in
    the order of the labels, as conditional binomials of counter-based uniform numbers:
    any engine that has md5 gets the same draws, wherever and how often a task runs.
    """
    by = list(by)
    listed = F.sort_array(F.collect_list(F.struct(
        F.col(TRUE).alias("t"), F.col(PRED).isNull().alias("none"), F.col(PRED).alias("p"), F.col("n").alias("n"))))
    groups = cells.where(F.col("n") > 0).groupBy(*by).agg(listed.alias("_cells")).withColumn(  # classes x classes entries at most
        "_seed", hash32(F.lit("bootstrap"), *[F.col(k) for k in by], seed=seed))
    blocks = groups.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAW_BLOCK))))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["draw int, n bigint, macro_f1 double"])

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                entries = row["_cells"]
                weights = np.array([c["n"] for c in entries], np.int64)
                truth, pred = (np.array([c[k] for c in entries], dtype=object) for k in ("t", "p"))
                numbers = np.arange(row["_first"], min(draws, row["_first"] + DRAW_BLOCK))
                drawn = multinomial_counts(weights, numbers, f"{seed}|{row['_seed']}")
                if not row["_first"]:
                    numbers, drawn = np.append(-1, numbers), np.vstack([weights, drawn])
                yield pd.DataFrame({**{k: [row[k]] * len(numbers) for k in by}, "draw": numbers.astype(np.int32),
                                    "n": int(weights.sum()), "macro_f1": _macro_f1(drawn, truth, pred, labels)})

    return blocks.repartition(*by, "_first").mapInPandas(resample, schema)


def bootstrap_macro_f1(
    cells: DataFrame,
    by: Sequence[str],
    labels: Sequence[str],
    draws: int = 1000,
    level: float = 0.95,
    seed: int = SEED,
    strata: Sequence[str] | None = None,
    stratum: str = "stratum",
) -> DataFrame:
    """(by, n, macro_f1, ci_low, ci_high) from confusion cells, by the percentiles of :func:`bootstrap_draws`.

    With ``strata``, a (group, stratum) without rows gives a row of NULLs and n = 0.
    """
    tail = (1.0 - level) / 2.0
    by = list(by)
    drawn = F.when(F.col("draw") >= 0, F.col("macro_f1"))
    result = bootstrap_draws(cells, by, labels, draws, seed).groupBy(*by).agg(  # as many values as draws
        F.max("n").alias("n"), F.max(F.when(F.col("draw") < 0, F.col("macro_f1"))).alias("macro_f1"),
        F.percentile(drawn, F.lit(tail)).alias("ci_low"), F.percentile(drawn, F.lit(1.0 - tail)).alias("ci_high"))
    if strata is None:
        return result
    others = [k for k in by if k != stratum]
    wanted = [*strata, OVERALL]
    frame = cells.select(*others).distinct().withColumn(stratum, F.explode(F.array(*[F.lit(s) for s in wanted])))
    return null_safe_join(frame, result, by, "left").select(
        *by, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "macro_f1", "ci_low", "ci_high"
    )


def poisson_cdf(resolution: float = 2.0 ** -32) -> list[float]:
    """Cumulative probabilities of a Poisson(1) variable up to where less than ``resolution`` is left."""
    total, bounds = Fraction(0), []
    while not bounds or 1 - bounds[-1] >= resolution:
        total += Fraction(1, math.factorial(len(bounds)))
        bounds.append(float(total) * math.exp(-1))
    return bounds


POISSON_ONE_CDF = poisson_cdf()
POISSON_ONE_DIGITS = [f"{math.ceil(bound * 2 ** 32):08x}" for bound in POISSON_ONE_CDF if math.ceil(bound * 2 ** 32) < 2 ** 32]


def poisson_weight_of_digits(word: Column) -> Column:
    """Poisson(1) count of a number given as eight hexadecimal digits, which sort as the numbers do."""
    weight = F.when(word < POISSON_ONE_DIGITS[0], 0)
    for count, bound in enumerate(POISSON_ONE_DIGITS[1:], start=1):
        weight = weight.when(word < bound, count)
    return weight.otherwise(len(POISSON_ONE_DIGITS))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform number of 32 bits; the table reaches as far as such a number does."""
    weight = F.when(u < POISSON_ONE_CDF[0], 0)
    for count, bound in enumerate(POISSON_ONE_CDF[1:], start=1):
        weight = weight.when(u < bound, count)
    return weight.otherwise(len(POISSON_ONE_CDF))


def poisson_bootstrap_f1(
    df: DataFrame, by: Sequence[str], item: str, draws: int, labels: Sequence[str] | None = None, seed: int = SEED
) -> DataFrame:
    """(by, draw, n, macro_f1): row-level variant that can be checked in SQL.

    Each row gets a Poisson(1) weight per draw from its hash (one md5 serves four
    draws), so the number of rows varies a little between draws. All draws are
    summed in one aggregation; rows are not multiplied.
    """
    keys = [*by, TRUE, PRED]
    blocks = -(-draws // 4)
    words = {f"_m{b}": md5_words(F.lit(f"draw{b}"), F.col(item), seed=seed) for b in range(blocks)}
    rows = df.where(F.col(TRUE).isNotNull()).select(*keys, *[w.alias(c) for c, w in words.items()])
    weighted = rows.groupBy(*keys).agg(*[
        F.sum(poisson_weight_of_digits(F.substring(f"_m{d // 4}", 1 + 8 * (d % 4), 8))).alias(f"_w{d}") for d in range(draws)])
    per_draw = F.inline(F.array(*[
        F.struct(F.lit(d).alias("draw"), F.col(f"_w{d}").cast("bigint").alias("n")) for d in range(draws)
    ]))
    cells = weighted.select(*keys, per_draw).where(F.col("n") > 0)
    return average_scores(class_scores(cells, [*by, "draw"], labels), [*by, "draw"]).select(
        *by, "draw", "n", "macro_f1")


def poisson_interval(draws: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """(by, ci_low, ci_high) of the draws; a group holds as many values as there are draws."""
    tail = (1.0 - level) / 2.0
    return draws.groupBy(*by).agg(
        F.percentile("macro_f1", F.lit(tail)).alias("ci_low"),
        F.percentile("macro_f1", F.lit(1.0 - tail)).alias("ci_high"),
    )


# --- McNemar -----------------------------------------------------------------

def paired_correct(
    df: DataFrame, item: str, models: Sequence[str], carry: Sequence[str] = (), model: str = "model"
) -> DataFrame:
    """One row per item with a boolean column per model: right or wrong.

    A single aggregation on the item replaces one self-join per model.
    """
    right = F.col(TRUE) == F.col(PRED)
    return (
        df.where(F.col(model).isin(list(models)) & F.col(TRUE).isNotNull())
        .groupBy(item, *carry)
        .agg(*[F.max(F.when(F.col(model) == m, F.coalesce(right, F.lit(False)))).alias(m) for m in models])
    )


def mcnemar_counts(
    paired: DataFrame, baseline: str, others: Sequence[str], stratum: str = "stratum",
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """(other, stratum, n, both, only_baseline, only_other, neither) with the overall margin.

    Items scored by only one of the two models are not paired and not counted.
    """
    names = ["both_correct", "only_baseline_correct", "only_other_correct", "neither_correct"]
    sums = []
    for m in others:
        a, b = F.col(baseline), F.col(m)
        for name, case in zip(names, (a & b, a & ~b, ~a & b, ~a & ~b)):
            sums.append(F.count_if(case).alias(f"{m}|{name}"))
    wide = paired.groupBy(stratum).agg(*sums)
    long = wide.select(stratum, F.inline(F.array(*[
        F.struct(F.lit(m).alias("other"), *[F.col(f"`{m}|{n}`").alias(n) for n in names]) for m in others
    ])))
    total = with_overall(long, stratum, names, strata)
    n = F.col(names[0]) + F.col(names[1]) + F.col(names[2]) + F.col(names[3])
    return total.withColumn("n", n).where(F.col("n") > 0).withColumn("baseline", F.lit(baseline))


def chi_square_statistic(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic; 0 without discordant pairs."""
    gap = (F.abs(b - c) - 1).cast("double")
    return F.coalesce(F.try_divide(gap * gap, (b + c).cast("double")), F.lit(0.0))


def mcnemar_p(b: int, c: int, exact: bool) -> float:
    if b + c == 0:
        return 1.0
    if exact:
        lower = sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)
        return min(1.0, 2.0 * lower)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / (b + c)) / math.sqrt(2.0))


def mcnemar_test(counts: DataFrame, exact_below: int = 25) -> DataFrame:
    """Add ``statistic`` and ``p_value`` to :func:`mcnemar_counts`.

    Below ``exact_below`` discordant pairs the exact binomial test is used, whose
    statistic is the smaller count; 0 turns it off. Only result rows reach Python.
    """
    b, c = F.col("only_baseline_correct"), F.col("only_other_correct")
    exact = (b + c) < exact_below
    statistic = F.when(exact, F.least(b, c).cast("double")).otherwise(chi_square_statistic(b, c))

    @pandas_udf("double")
    def p_value(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(x), int(y), x + y < exact_below) for x, y in zip(b, c)], dtype="float64")

    return counts.withColumns({"statistic": statistic, "p_value": p_value(b, c)})


# --- stricter subsets --------------------------------------------------------

def sensitivity_cells(
    df: DataFrame, confidence: str, thresholds: Sequence[float], by: Sequence[str], stratum: str,
    strata: Sequence[str] | None = None,
) -> DataFrame:
    """Confusion cells per confidence threshold, with the overall margin.

    Rows are counted once, at the number of thresholds they reach; the nested
    subsets are then summed on the cells. Input of the metrics and the bootstrap.
    """
    ascending = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    reached = sum((F.when(F.col(confidence) >= float(t), 1).otherwise(0) for t in thresholds), F.lit(0))
    counted = confusion_cells(df.withColumn("_reached", reached), ["_reached", *by, stratum])
    nested = (
        counted.where(F.col("_reached") > 0)
        .withColumn("threshold", F.explode(F.slice(ascending, F.lit(1), F.col("_reached"))))
        .groupBy("threshold", *by, stratum, TRUE, PRED).agg(F.sum("n").alias("n"))
    )
    return with_overall(nested, stratum, ["n"], strata)
