"""Quotas, pairing, acceptance, weights and draws."""

import math

import pytest
from pyspark.sql import functions as F

from evenhand.operators import balance
from evenhand.plans.balancing import balance_classes


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"l{i}", "Light", 0.9) for i in range(40)] + [(f"m{i}", "Medium", 0.4 + i / 50) for i in range(15)] + [
        (f"d{i}", "Dark", 0.7) for i in range(5)]
    return spark.createDataFrame(rows, "image_id string, label string, confidence double")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_deficits_and_donors(spark, items):
    got = by(balance.class_deficits(items, "label", 20, ["Light", "Medium", "Dark", "None"]), "class")
    assert {k[0]: (r["n"], r["deficit"], r["donor"]) for k, r in got.items()} == {
        "Light": (40, 0, "Medium"), "Medium": (15, 5, "Light"), "Dark": (5, 15, "Light"), "None": (0, 20, "Light")}


def test_quotas_round_half_even(spark):
    deficits = spark.createDataFrame([("a", 1), ("b", 3), ("c", 5)], "class string, deficit bigint")
    got = by(balance.method_quotas(deficits, [0.5]), "class", "method")
    assert [got[(c, "reinhard")]["quota"] for c in "abc"] == [0, 2, 2]
    assert [got[(c, "deep_blend")]["quota"] for c in "abc"] == [1, 1, 3]


def run(items, gate, **kw):
    return balance_classes(items, items, "label", "image_id", gate, [0.0, 0.3, 1.0], **kw)


def test_quotas_are_met_exactly_when_enough_pass(items):
    job = run(items, lambda a: a.withColumn("reason", F.when(F.col("attempt") % 3 == 0, "dark=3").otherwise("ok")))
    report = by(job.report, "ratio", "class")
    for (ratio, label), r in report.items():
        assert r["accepted"] == r["deficit"] and r["final_n"] == 40 and not r["drift"]
        assert r["accepted_first"] == round(r["deficit"] * ratio)
    rows = job.accepted.collect()
    assert all(r["source_class"] != r["target"] for r in rows)
    assert len({(r["ratio"], r["target"], r["attempt"]) for r in rows}) == len(rows)
    names = [r["output_name"] for r in job.manifest.where("ratio = 0.3").collect()]
    assert len(set(names)) == len(names) == 25 + 35
    assert {r["reason"] for r in job.reasons.collect()} == {"dark"}


def test_shortfall_and_drift_are_reported(items):
    few = run(items, lambda a: a.withColumn("reason", F.when(F.col("attempt") < 4, "ok").otherwise("blur=1")))
    report = by(few.report, "ratio", "class")
    for key, r in report.items():
        assert r["accepted"] <= 4 and r["shortfall"] == r["deficit"] - r["accepted"]
    assert any(r["drift"] for r in report.values())


def test_attempts_cover_sources_evenly_and_references_match(spark, items):
    deficits = balance.class_deficits(items, "label")
    sources = balance.source_pool(items, "label", "image_id", deficits)
    given = items.where("label = 'Medium'")
    references = balance.reference_pool(given, items, "label", "image_id", deficits)
    attempts = balance.candidate_attempts(sources, references, deficits, 1.5, 4).collect()
    dark = sorted((r for r in attempts if r["target"] == "Dark"), key=lambda r: r["attempt"])
    total = int(35 * 1.5) * 3 + 35 * 3
    assert [r["attempt"] for r in dark] == list(range(total))
    assert {r["cycle"] for r in dark} == {1, 2, 3, 4}
    first = [r["source_id"] for r in dark[:55]]
    assert len(set(first)) == 55 and [r["source_id"] for r in dark[55:110]] == first
    assert all(r["reference_id"].startswith("d") for r in dark)  # fallback: no Dark references were given
    other = balance.candidate_attempts(sources.repartition(9), references.repartition(3), deficits, 1.5, 4).collect()
    assert {tuple(r) for r in other} == {tuple(r) for r in attempts}


def test_weights(spark, items):
    counts = balance.class_counts(items, "label", ["Light", "Medium", "Dark", "None"])
    for strategy in balance.WEIGHT_STRATEGIES:
        rows = by(balance.class_weights(counts, strategy, 0.5, 3.0), "class")
        assert sum(r["weight"] for r in rows.values()) == pytest.approx(1.0)
    inverse = by(balance.class_weights(counts, "inverse"), "class")
    assert inverse[("Dark",)]["weight"] / inverse[("Light",)]["weight"] == pytest.approx(8.0)
    capped = by(balance.class_weights(counts, "capped", max_oversample=3.0), "class")
    assert capped[("Dark",)]["weight"] / capped[("Light",)]["weight"] == pytest.approx(3.0)
    with pytest.raises(ValueError):
        balance.class_weights(counts, "other")
    present = balance.class_counts(items, "label")
    assert by(balance.loss_weights(present), "class")[("Dark",)]["weight"] == pytest.approx(60 / (3 * 5))
    roots = [r["weight"] for r in balance.loss_weights(present, "inverse_sqrt").collect()]
    assert sum(roots) / 3 == pytest.approx(1.0)
    assert by(balance.loss_weights(counts), "class")[("None",)]["weight"] == 1.0


def test_weighted_draw_meets_expectation_per_row(spark, items):
    weights = balance.class_weights(balance.class_counts(items, "label"), "inverse")
    expected = balance.expected_copies(weights, "balanced")
    per_class = by(expected, "class")
    assert per_class[("Dark",)]["copies_per_row"] == pytest.approx(8.0)
    drawn = balance.weighted_draw(items, "label", "image_id", expected).groupBy("image_id", "label").count().collect()
    for r in drawn:
        e = per_class[(r["label"],)]["copies_per_row"]
        assert math.floor(e - 1e-9) <= r["count"] <= math.ceil(e + 1e-9)


def test_tiers(spark):
    counts = spark.createDataFrame([("a", 4), ("b", 10), ("c", 86)], "class string, n bigint")
    assert {r["class"]: r["tier"] for r in balance.class_tiers(counts).collect()} == {"a": "severe", "b": "minority", "c": "regular"}


def test_transfer_batch(items):
    rows = balance.transfer_batch(items, "label", "image_id", "confidence", balance.class_deficits(items, "label")).collect()
    assert {r["transferred_class"] for r in rows} == {"Medium", "Dark"}
    assert sum(r["transferred_class"] == "Medium" for r in rows) == 25
    assert all(r["original_class"] == "Light" and r["augmented_file"].endswith(".jpg") for r in rows)
