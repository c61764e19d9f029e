"""Metrics, AUC, paired tests and bootstrap on hand-made rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import inference, joins, metrics, roc

KEYS = ["model", "stratum"]


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        ("m", "Light", "A", "A"), ("m", "Light", "A", "B"), ("m", "Light", "B", "B"),
        ("m", "Dark", "A", "C"), ("m", "Dark", "B", "B"), ("m", None, "A", "A"), ("m", "Other", "B", "A"),
    ]
    return spark.createDataFrame(rows, "model string, stratum string, true_class string, pred_class string")


def test_cells_sum_to_rows_and_margin_counts_every_row(scored):
    cells = metrics.with_overall(metrics.confusion_cells(scored, KEYS), "stratum", ["n"], ["Light", "Dark"])
    totals = rows_by(cells.groupBy("stratum").agg(F.sum("n").alias("n")), "stratum")
    assert {k: v["n"] for k, v in totals.items()} == {"Light": 3, "Dark": 2, "Overall": 7}


def test_label_list_counts_absent_classes_and_outside_predictions(scored):
    cells = metrics.confusion_cells(scored.where("stratum = 'Dark'"), ["model"])
    per_class = rows_by(metrics.class_scores(cells, ["model"], ["A", "B", "Z"]), "class")
    assert per_class["A"]["recall"] == 0.0 and per_class["A"]["support"] == 1  # predicted as C, outside the list
    assert per_class["Z"]["f1"] == 0.0 and per_class["Z"]["support"] == 0
    fixed = metrics.average_scores(metrics.class_scores(cells, ["model"], ["A", "B", "Z"]), ["model"]).first()
    assert fixed["macro_f1"] == pytest.approx(1 / 3)
    seen = metrics.average_scores(metrics.class_scores(cells, ["model"]), ["model"]).first()
    assert seen["macro_f1"] == pytest.approx(1 / 3)  # A, B and C seen, only B right
    assert seen["balanced_accuracy"] == pytest.approx(0.5)


def test_dense_cells_hold_zeros(scored):
    dense = metrics.dense_cells(metrics.confusion_cells(scored, ["model"]), ["model"], ["A", "B"])
    counts = {(r["true_class"], r["pred_class"]): r["n"] for r in dense.collect()}
    assert counts == {("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 2}


def test_best_model_first_listed_wins_ties(spark):
    table = spark.createDataFrame([("b", 0.5, 0.1), ("a", 0.5, 0.2)], "model string, acc double, f1 double")
    best = rows_by(metrics.best_model(table, ["acc", "f1"], {"b": 0, "a": 1}), "metric")
    assert best["acc"]["model"] == "b" and best["f1"]["model"] == "a"


def test_unknown_rows_and_class_names(spark):
    truth = spark.createDataFrame(
        [("x", 1.0, 1.0, 0.0), ("y", 0.0, 1.0, 0.0), ("z", 0.0, 0.0, 1.0)], "image_id string, A double, B double, UNK double")
    kept = {r["image_id"]: r["true_class"] for r in joins.label_ground_truth(truth, ["A", "B"]).collect()}
    assert kept == {"x": "A", "y": "B"}
    full = {r["image_id"]: r["true_class"]
            for r in joins.label_ground_truth(truth, ["A", "B"], include_unknown=True).collect()}
    assert full["z"] == "UNK"


def pairwise_auc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["ties", "tiny", "near_one", "negative", "mixed"])
def test_auc_equals_pairwise_definition(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "ties": lambda: round(rnd.random(), 1), "tiny": lambda: 10.0 ** -rnd.uniform(5, 300),
        "near_one": lambda: 1.0 - rnd.random() * 1e-9, "negative": lambda: -rnd.expovariate(1.0),
        "mixed": lambda: rnd.choice([0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, rnd.gauss(0, 1)]),
    }[kind]
    data = [(rnd.choice("AB"), draw()) for _ in range(300)]
    df = spark.createDataFrame([("m", t, [s, 1.0]) for t, s in data], "model string, true_class string, probs array<double>")
    cells = roc.score_cells(df, ["model"], ["A", "never"])
    got = rows_by(roc.auc_by_class(cells, ["model"]), "class")
    expected = pairwise_auc([s for t, s in data if t == "A"], [s for t, s in data if t != "A"])
    assert got["A"]["auc"] == pytest.approx(expected, abs=1e-12)
    assert got["never"]["auc"] is None
    assert roc.macro_auc(roc.auc_by_class(cells, ["model"]), ["model"]).first()["macro_auc"] == pytest.approx(expected)
    assert roc.macro_auc(roc.auc_by_class(cells, ["model"]), ["model"], "zero").first()["macro_auc"] == 0.0


def test_one_class_only_has_no_auc(spark):
    df = spark.createDataFrame([("m", "A", [0.3, 0.7])], "model string, true_class string, probs array<double>")
    auc = roc.auc_by_class(roc.score_cells(df, ["model"], ["A", "B"]), ["model"])
    assert roc.macro_auc(auc, ["model"]).first()["macro_auc"] is None
    assert roc.roc_points(roc.score_cells(df, ["model"], ["A", "B"]), ["model"]).count() == 0


def test_roc_area_equals_auc_with_and_without_collinear_points(spark):
    rnd = random.Random(3)
    data = [("m", "A" if rnd.random() < 0.3 else "B", [round(rnd.random(), 2), 0.0]) for _ in range(400)]
    df = spark.createDataFrame(data, "model string, true_class string, probs array<double>")
    cells = roc.score_cells(df, ["model"], ["A", "B"])
    area = rows_by(roc.auc_by_class(cells, ["model"]), "class")["A"]["auc"]
    sizes = []
    for drop in (False, True):
        pts = sorted((r["fpr"], r["tpr"]) for r in roc.roc_points(cells, ["model"], drop).where("class = 'A'").collect())
        sizes.append(len(pts))
        assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:])) == pytest.approx(area)
    assert sizes[1] < sizes[0]


@pytest.mark.parametrize("b,c,exact", [(0, 0, True), (1, 5, True), (12, 12, True), (10, 14, True), (3, 22, False)])
def test_mcnemar_exact_and_chi_square(spark, b, c, exact):
    rows = [("i%d" % i, "s", i < b, b <= i < b + c) for i in range(b + c)] + [("both", "s", True, True)]
    paired = spark.createDataFrame(rows, "item string, stratum string, base boolean, other boolean")
    counts = inference.mcnemar_counts(paired, "base", ["other"], "stratum", ["s"])
    row = rows_by(inference.mcnemar_test(counts), "stratum")["s"]
    assert (row["only_baseline_correct"], row["only_other_correct"], row["both_correct"]) == (b, c, 1)
    if b + c == 0:
        assert (row["statistic"], row["p_value"]) == (0.0, 1.0)
    elif exact:
        p = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
        assert row["statistic"] == min(b, c) and row["p_value"] == pytest.approx(p)
    else:
        stat = (abs(b - c) - 1) ** 2 / (b + c)
        assert row["statistic"] == pytest.approx(stat) and row["p_value"] == pytest.approx(math.erfc(math.sqrt(stat / 2)))
    always = rows_by(inference.mcnemar_test(counts, exact_below=0), "stratum")["s"]
    assert always["statistic"] == pytest.approx(0.0 if b + c == 0 else (abs(b - c) - 1) ** 2 / (b + c))


def test_bootstrap_agrees_with_row_resampling(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 4, 600)
    pred = np.where(rng.random(600) < 0.7, truth, rng.integers(0, 4, 600))
    df = spark.createDataFrame([("m", "s", str(t), str(p)) for t, p in zip(truth, pred)],
                               "model string, stratum string, true_class string, pred_class string")
    labels = ["0", "1", "2", "3"]
    cells = metrics.confusion_cells(df, KEYS)
    got = inference.bootstrap_macro_f1(cells, KEYS, labels, draws=1000).first()

    def f1(t, p):
        return np.mean([2 * ((t == k) & (p == k)).sum() / max((t == k).sum() + (p == k).sum(), 1) for k in range(4)])

    draws = [f1(truth[i], pred[i]) for i in (rng.integers(0, 600, 600) for _ in range(1000))]
    assert got["n"] == 600 and got["macro_f1"] == pytest.approx(f1(truth, pred))
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got["ci_low"] == pytest.approx(low, abs=0.012) and got["ci_high"] == pytest.approx(high, abs=0.012)
    again = inference.bootstrap_macro_f1(cells.repartition(7), KEYS, labels, draws=1000).first()
    assert again == got


def test_bootstrap_keeps_empty_strata(spark, scored):
    cells = metrics.with_overall(metrics.confusion_cells(scored, KEYS), "stratum", ["n"], ["Light", "Dark", "Medium"])
    got = rows_by(inference.bootstrap_macro_f1(cells, KEYS, ["A", "B"], 50, strata=["Light", "Dark", "Medium"]), "stratum")
    assert got["Medium"]["n"] == 0 and got["Medium"]["macro_f1"] is None and got["Overall"]["n"] == 7


def test_unpaired_items_are_not_counted(spark):
    rows = [("a", "s", "m1", "X", "X"), ("a", "s", "m2", "X", "Y"), ("b", "s", "m1", "X", "X")]
    df = spark.createDataFrame(rows, "item string, stratum string, model string, true_class string, pred_class string")
    counts = inference.mcnemar_counts(
        inference.paired_correct(df, "item", ["m1", "m2"], ["stratum"]), "m1", ["m2"], "stratum", ["s"])
    assert rows_by(counts, "stratum")["s"]["n"] == 1
