"""Ranks, cuts, quantiles, samples and splits: exact, repeatable, hot groups included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions.hashing import hash32
from evenhand.functions.radix import digits
from evenhand.operators import balance, ranking, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one class, one class of one row, a NULL class."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else "lone" if i == 2 else f"k{i % 7}") for i in range(6000)]
    return spark.createDataFrame(rows, "id long, label string")


def expected_order(spark, df):
    rows = df.withColumn("h", hash32(F.col("id"))).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["id"])):
        groups.setdefault(r["label"], []).append(r["id"])
    return groups


def test_digits_follow_the_order(spark):
    rnd = random.Random(1)
    values = sorted({rnd.choice([1, -1]) * 10.0 ** rnd.uniform(-320, 308) for _ in range(2000)}
                    | {0.0, 1.0, -1.0, 5e-324, 1.7e308} | {1 - k * 2.0**-53 for k in range(200)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    coarse, fine = digits(F.col("v"))
    got = [(r["c"], r["f"]) for r in df.select("v", coarse.alias("c"), fine.alias("f")).orderBy("v").collect()]
    assert got == sorted(got)


def test_number_rows_is_dense_and_exact(spark, skewed):
    rows = skewed.withColumn("h", hash32(F.col("id")))
    got = ranking.number_rows(rows, ["label"], ["h", "id"], ranking.hash_bucket(F.col("h"), 4), size="n").collect()
    wanted = expected_order(spark, skewed)
    assert len(got) == 6000
    for r in got:
        assert wanted[r["label"]][r["idx"]] == r["id"] and r["n"] == len(wanted[r["label"]])


@pytest.mark.parametrize("n", [0, 1, 37, 1500, 100000])
def test_take_first_equals_plain_rank(spark, skewed, n):
    rows = skewed.withColumn("h", hash32(F.col("id")))
    got = ranking.take_first(rows, ["label"], ["h", "id"], ranking.hash_bucket(F.col("h")), n).collect()
    kept = {}
    for r in got:
        kept.setdefault(r["label"], set()).add(r["id"])
    assert kept == {k: set(v[:n]) for k, v in expected_order(spark, skewed).items() if n > 0}


def test_sample_is_the_same_for_any_partitioning_and_path(spark, skewed):
    small = {r["id"] for r in sampling.sample_per_class(skewed, "label", "id", 40).collect()}
    other = {r["id"] for r in sampling.sample_per_class(skewed.repartition(16), "label", "id", 40).collect()}
    rows = skewed.withColumn("_h", hash32(F.col("id")))
    radix = {r["id"] for r in ranking.take_first(
        rows, ["label"], ["_h", "id"], ranking.hash_bucket(F.col("_h")), 40).collect()}
    assert small == other == radix


def test_cap_only_touches_the_named_rows(spark, skewed):
    rows = skewed.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("val"))
    kept = sampling.cap_per_class(rows, "label", "id", 100, only=F.col("split") == "train")
    counts = {(r["label"], r["split"]): r["n"] for r in kept.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[("hot", "train")] == 100 and counts[("hot", "val")] == 1000
    assert sampling.cap_per_class(rows, "label", "id", 0) is rows


@pytest.mark.parametrize("holdout,names", [([0.2], ["train", "val"]), ([0.15, 0.333], ["train", "validation", "test"])])
def test_split_sizes_cover_and_are_stratified(spark, skewed, holdout, names):
    labelled = skewed.where("label is not null")
    parts = sampling.stratified_split(labelled, ["label"], "id", holdout, names)
    rows = parts.collect()
    total = labelled.count()
    assert len(rows) == total and len({r["id"] for r in rows}) == total
    sizes = {n: sum(r["split"] == n for r in rows) for n in names}
    rest = total
    for fraction, name in zip(holdout, names):
        held = math.ceil(rest * fraction)
        assert sizes[name] == rest - held
        rest = held
    assert sizes[names[-1]] == rest
    for label in {r["label"] for r in rows}:
        size = sum(r["label"] == label for r in rows)
        train = sum(r["label"] == label and r["split"] == names[0] for r in rows)
        assert abs(train - size * sizes[names[0]] / total) < 1
    same = sampling.stratified_split(labelled.repartition(5), ["label"], "id", holdout, names)
    assert {(r["id"], r["split"]) for r in same.collect()} == {(r["id"], r["split"]) for r in rows}


def test_unstratified_split(spark, skewed):
    parts = sampling.stratified_split(skewed, [], "id", [0.1], ["train", "eval"])
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 5400, "eval": 600}
    assert "_all" not in parts.columns


def test_hash_split_and_predefined(spark, skewed):
    parts = sampling.hash_split(skewed, "id", [0.85, 0.1, 0.05], ["train", "validation", "test"])
    share = parts.where("split = 'train'").count() / 6000
    assert abs(share - 0.85) < 0.03
    assert sampling.predefined_split(parts, "all").count() == 6000


def test_sample_budget(spark, skewed):
    got = sampling.sample_budget_per_class(skewed.where("label is not null"), "label", "id", 90).groupBy("label").count()
    sizes = {r["label"]: r["count"] for r in got.collect()}
    assert sizes.pop("lone") == 1 and set(sizes.values()) == {10}


@pytest.mark.parametrize("kind", ["uniform", "ties", "narrow", "heavy", "tiny"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    make = {
        "uniform": lambda n: rng.random(n), "ties": lambda n: rng.integers(0, 4, n).astype(float),
        "narrow": lambda n: 1 - rng.random(n) * 1e-10, "heavy": lambda n: rng.standard_cauchy(n) * 1e5,
        "tiny": lambda n: 10.0 ** -rng.uniform(1, 300, n),
    }[kind]
    groups = {"a": make(1000), "b": make(1), "c": make(2), "d": make(37)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in ranking.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert len(got) == 4 * len(probs)
    for k, vs in groups.items():
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p), rel=1e-9, abs=1e-300)


def test_exact_quantiles_without_keys(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert ranking.exact_quantiles(df, [], "v", [0.5]).first()["quantile"] == 5.0


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 10000), (4, 4096), (5, 4097)], "id int, k int")
    got = balance.repeat_rows(df, F.col("k")).groupBy("id").agg(
        F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.count_distinct("copy").alias("d"))
    assert {r["id"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in got.collect()} == {
        2: (1, 1, 1, 1), 3: (10000, 1, 10000, 10000), 4: (4096, 1, 4096, 4096), 5: (4097, 1, 4097, 4097)}


@pytest.mark.parametrize("operator", ["split", "sample", "cap"])
def test_wide_rows_are_not_shuffled(spark, operator):
    """With a limit below the input's size the cuts are written, and the last step is a broadcast join."""
    wide = spark.range(300_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 5)) as label", "repeat('x', 50) as body")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        result = {
            "split": lambda: sampling.stratified_split(wide, ["label"], "id", [0.2], ["train", "val"]),
            "sample": lambda: sampling.sample_per_class(wide, "label", "id", 100),
            "cap": lambda: sampling.cap_per_class(wide, "label", "id", 30_000),
        }[operator]()
        plan = result._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
        expected = {"split": 300_000, "sample": 600, "cap": 180_000}[operator]
        assert result.count() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weighted_quantiles_leave_out_missing_values(spark):
    cells = spark.createDataFrame([("a", None, 5), ("a", float("nan"), 5), ("a", 0.0, 1), ("a", 3.0, 1)],
                                  "k string, v double, times long")
    got = ranking.exact_quantiles(cells, ["k"], "v", [0.5, 1.0], weight="times").orderBy("prob").collect()
    assert [r["quantile"] for r in got] == [1.5, 3.0]


def test_a_join_without_keys_is_refused(spark):
    with pytest.raises(ValueError):
        ranking.null_safe_join(spark.range(2), spark.range(2), [])


def test_one_group_without_keys(spark):
    from evenhand.operators.audit import confidence_histogram
    from evenhand.operators.realism import robust_consensus

    values = spark.createDataFrame([(float(i),) for i in range(8)], "v double")
    assert sorted(tuple(r) for r in confidence_histogram(values, [], "v", 2).collect()) == [(0, 0.0, 3.5, 4), (1, 3.5, 7.0, 4)]
    assert [r["median"] for r in robust_consensus(values, [], "v").collect()] == [3.5]
