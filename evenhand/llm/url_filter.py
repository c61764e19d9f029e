"""URL verdicts: rules by host and path, and a character model ratio for the rest.

URLs that a rule allows or blocks train one variable-order Markov model each. The
probability of a character after a context of up to four others is smoothed by that
after the context without its first character, and so on down. A URL that no rule
fits is judged by the difference of its mean log probabilities, against a threshold
that is calibrated on labelled URLs kept out of the training.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.hashing import hash32
from evenhand.session import reliable_checkpoint

ORDER = 4  # characters of the longest context
SMOOTHING = 4.0  # weight of the shorter context, in characters seen
SENT_ROWS = 20_000  # bound of the strings whose ratio is sent to all tasks: those that are 1 / SENT_ROWS of all or more
FOLDS = 5  # one fold of the labelled URLs calibrates
BINS_PER_UNIT = 50  # steps of the threshold
REACH = 5  # the threshold lies between -REACH and REACH
START = "\x02"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def with_parts(pages: DataFrame, url: str) -> DataFrame:
    """``host`` and ``path`` of the URL, both empty if it is null or has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule`` and ``ruled`` of the longest rule that fits, null without one; of equally long rules block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.host + r.path).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def strings() -> Column:
    """One string of ORDER + 1 characters for each character of host and path: the character after its context."""
    text = F.concat(F.lit(START * ORDER), F.col("host"), F.col("path"))
    n = F.length(text) - ORDER
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(ORDER + 1))))


def ending(length: int, name: str = "string") -> Column:
    """The last ``length`` characters of a string of ORDER + 1."""
    return F.substring(name, ORDER + 2 - length, length)


def model_levels(counts: DataFrame) -> list[DataFrame]:
    """By context length 0 to ORDER: (string, ratio) of all strings seen.

    ``counts`` has (string, a, b): how often each string was seen in allowed and blocked
    URLs. ``ratio`` is the log of the character's probability in allowed URLs to that in
    blocked ones.
    """
    levels: list[DataFrame] = []
    for k in range(ORDER + 1):
        seen = counts.groupBy(ending(k + 1).alias("string")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.substring("string", ORDER + 1 - k, k)
        after = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"))
        joined = seen.withColumn("context", F.substring("string", 1, k)).join(after, "context")
        if k:
            shorter = levels[-1].select(F.col("string").alias("shorter"), F.col("p_a").alias("q_a"), F.col("p_b").alias("q_b"))
            joined = joined.withColumn("shorter", F.substring("string", 2, k)).join(shorter, "shorter")
        else:
            joined = joined.withColumns({"q_a": F.lit(1 / 256), "q_b": F.lit(1 / 256)})
        smooth = lambda n, of, q: (F.col(n) + F.lit(SMOOTHING) * F.col(q)) / (F.col(of) + F.lit(SMOOTHING))
        levels.append(reliable_checkpoint(joined.select(
            "string", smooth("a", "in_a", "q_a").alias("p_a"), smooth("b", "in_b", "q_b").alias("p_b")), "url-model"))
    return [level.select("string", (F.log("p_a") - F.log("p_b")).alias("ratio")) for level in levels]


def string_ratios(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``asked`` (string, n) with the ``ratio`` of the longest ending that the model has, 0 without one."""
    ratio = F.lit(0.0)
    for k, level in enumerate(levels):
        named = level.select(F.col("string").alias(f"_s{k}"), F.col("ratio").alias(f"_r{k}"))
        asked = asked.join(named, ending(k + 1) == F.col(f"_s{k}"), "left")
        ratio = F.coalesce(F.col(f"_r{k}"), ratio)
    return asked.select("string", "n", ratio.alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The step that best parts allowed from blocked URLs of the fold; 0 if it holds only one kind.

    ``scored`` has (ruled, score). Best is the largest sum of the shares that are judged
    right; of a stretch of equally good steps it is the middle, ties go to the one nearest 0.
    """
    step = F.greatest(F.least(F.floor(F.col("score") * BINS_PER_UNIT), F.lit(REACH * BINS_PER_UNIT)), F.lit(-REACH * BINS_PER_UNIT))
    bins = scored.groupBy(step.alias("step")).agg(
        F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    whole, below = Window.partitionBy(), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("step").over(below)
    middle = F.coalesce(F.floor((last + 1 + F.col("step")) / 2), "step").alias("middle")
    parted = bins.select(  # at most 2 REACH BINS_PER_UNIT + 1 rows
        middle, F.sum("a").over(whole).alias("all_a"), F.sum("b").over(whole).alias("all_b"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("low_a"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("low_b"))
    right = (F.col("all_a") - F.col("low_a")) * F.col("all_b") + F.col("low_b") * F.col("all_a")
    best = parted.where((F.col("all_a") > 0) & (F.col("all_b") > 0)).orderBy(right.desc(), F.abs("middle"), "middle").first()
    return best.middle / BINS_PER_UNIT if best else 0.0


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
          sent_rows: int = SENT_ROWS) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of ``pages``.

    ``verdict`` is that of the longest rule that fits, else the model's: allow if
    ``score``, the mean log ratio of the characters of host and path, reaches the
    threshold. Characters are judged by the longest string that was seen in training. The
    distinct strings of all URLs meet the whole model in joins; the ratios of at most
    ``sent_rows`` frequent ones are sent to all tasks, the others are joined with the few
    characters that need them. A null
    URL, one without ``://`` and one with neither host nor path have the score 0, which
    is also the threshold if one kind of label is missing. Null keys are allowed,
    repeated rows train and are judged one by one, an empty table gives an empty table;
    other columns are not read, so their names cannot clash.
    """
    parts = with_rule(with_parts(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url"), rules)
    parts = parts.withColumn("_fold", hash32(F.col("_url")) % FOLDS).drop("_url")
    training = parts.where(F.col("ruled").isNotNull() & (F.col("_fold") != 0))
    counts = reliable_checkpoint(
        training.select("ruled", F.explode(strings()).alias("string")).groupBy("string").agg(
            F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")), "url-strings")
    rows = parts.withColumn("_row", F.monotonically_increasing_id())
    asked = reliable_checkpoint(rows.select(F.explode(strings()).alias("string")).groupBy("string").agg(
        F.count(F.lit(1)).alias("n")), "url-asked")
    ratios = reliable_checkpoint(string_ratios(asked, model_levels(counts)), "url-ratios")
    total = asked.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * sent_rows >= total
    sent = ratios.where(often).select("string", "ratio")
    found = rows.withColumn("string", F.explode_outer(strings())).join(F.broadcast(sent), "string", "left")  # at most ``sent_rows`` rows
    once = [F.first(c).alias(c) for c in ("_key", "host", "path", "rule", "ruled", "_fold")]
    rare = F.collect_list(F.when(F.col("ratio").isNull(), F.col("string")))  # at most the characters of one URL
    known = reliable_checkpoint(found.groupBy("_row").agg(
        *once, F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("sum"), F.count("string").alias("n"), rare.alias("rare")), "url-known")
    others = known.select("_row", F.explode("rare").alias("string")).join(ratios.where(~often), "string").groupBy("_row").agg(
        F.sum("ratio").alias("more"))
    score = F.when(F.col("n") > 0, (F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.col("n")).otherwise(0.0)
    scored = reliable_checkpoint(known.join(others, "_row", "left").select(
        "_key", "host", "path", "rule", "ruled", "_fold", score.alias("score")), "url-scores")
    limit = threshold(scored.where(F.col("ruled").isNotNull() & (F.col("_fold") == 0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
