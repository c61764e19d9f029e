"""Scales, bins, identifiers and joins on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from evenhand.functions import arrays as A
from evenhand.functions import labels as L
from evenhand.operators import audit, joins, realism
from evenhand.schemas import MissingColumnsError, nan_to_null, require_columns


def values(spark, rows, ddl, *columns):
    got = spark.createDataFrame(rows, ddl).select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in got]


def test_ita_bins_at_the_edges(spark):
    rows = [(x,) for x in (-100.0, -90.0, -55.0, -41.0, 10.0, 54.99, 70.0, 90.0, 120.0, float("nan"), None)]
    got = values(spark, rows, "x double", L.ita_to_mst10(F.col("x")), L.ita_to_mst5(F.col("x")))
    assert [g[0] for g in got] == [0, 0, 1, 2, 5, 7, 9, 9, 9, -1, -1]
    assert [g[1] for g in got] == [0, 0, 0, 1, 2, 3, 4, 4, 4, -1, -1]


def test_ratings_to_names(spark):
    rows = [(x,) for x in (0.0, 1.0, 2.0, 5.0, 10.0, 11.0, float("nan"), None)]
    got = values(spark, rows, "x double", L.mst10_name(F.col("x")))
    assert got == [None, "Very Light (MST 1-2)", "Very Light (MST 1-2)", "Medium (MST 5-6)", "Very Dark (MST 9-10)",
                   None, None, None]


def test_first_maximum_wins(spark):
    got = values(spark, [([0.2, 0.4, 0.4],), ([0.0, 0.0],)], "p array<double>", L.predicted_class(F.col("p"), ["a", "b", "c"]))
    assert got == ["b", "a"]


def test_numbers_from_dirty_text(spark):
    rows = [("3",), (" 4.0 ",), ("x",), ("NaN",), (None,), ("7",)]
    assert values(spark, rows, "t string", L.to_number(F.col("t"), 1, 6)) == [3.0, 4.0, None, None, None, None]


def test_stems_and_names(spark):
    rows = [("/a/b.jpg",), ("b.tar.gz",), ("plain",), (".hidden",), ("/x/ISIC_1_overlay.jpg",)]
    assert values(spark, rows, "p string", L.stem(F.col("p"))) == ["b", "b.tar", "plain", ".hidden", "ISIC_1_overlay"]
    assert values(spark, [("v2 (λ=0.7) Test",)], "n string", L.safe_name(F.col("n"))) == ["v2_λ0.7_test"]


def test_stars(spark):
    rows = [(0.0005,), (0.005,), (0.03,), (0.05,), (None,)]
    assert values(spark, rows, "p double", L.significance_stars(F.col("p"))) == ["***", "**", "*", "ns", None]


def test_array_statistics(spark):
    rows = [([1.0, 2.0, 3.0, 10.0],), ([5.0],), ([],)]
    c = F.col("c")
    got = values(spark, rows, "c array<double>", A.mean(c), A.std_pop(c), A.median(c), A.quantile(c, 0.25))
    assert got[0] == (4.0, pytest.approx(math.sqrt(12.5)), 2.5, 1.75)
    assert got[1] == (5.0, 0.0, 5.0, 5.0) and got[2] == (None, None, None, None)


def test_transfer_guards_and_clipping(spark):
    m = F.lit(1.0)
    rows = [([1.0, 1.0],)]
    flat = A.transfer_channel(F.col("c"), m, F.lit(0.0), F.lit(7.0), F.lit(2.0), guard="one")
    assert values(spark, rows, "c array<double>", flat) == [[7.0, 7.0]]
    clipped = A.transfer_channel(F.col("c"), F.lit(0.0), m, F.lit(300.0), m)
    assert values(spark, rows, "c array<double>", clipped) == [[255.0, 255.0]]
    with pytest.raises(ValueError):
        A.transfer_channel(F.col("c"), m, m, m, m, guard="none")


def test_heatmap_words(spark):
    def heat(h, w, *hot):
        return [1.0 if (y, x) in hot else 0.0 for y in range(h) for x in range(w)]

    rows = [(heat(6, 6),), (heat(6, 6, (0, 0)),), (heat(6, 6, (3, 3)),), (heat(6, 6, (5, 3)),), (heat(6, 6, (3, 0)),)]
    assert values(spark, rows, "c array<double>", A.focus_region(F.col("c"), 6, 6)) == [
        "diffuse", "upper-left", "center", "lower", "left"]
    rows = [([0.9, 0.1],), ([0.5, 0.31],), ([0.35, 0.0],), ([0.1],)]
    assert values(spark, rows, "c array<double>", A.intensity_word(F.col("c"))) == ["strong", "moderate", "weak", "weak"]


def test_realism_rules_name_the_first_and_its_value(spark):
    wanted = dict.fromkeys(f for _, f, _, _ in realism.REALISM_RULES)
    base = {"border_hue_median": 10.0, "border_sat_mean": 100.0, "border_val_mean": 100.0, "center_hue_median": 10.0,
            "center_sat_mean": 100.0, "border_a_mean": 140.0, "border_b_mean": 140.0, "border_a_std": 5.0,
            "border_b_std": 5.0, "center_a_mean": 140.0, "center_b_mean": 140.0}
    changes = [{}, {"border_hue_median": 100.5, "border_sat_mean": 250.0}, {"border_hue_median": 30.0},
               {"border_val_mean": 24.5}, {"border_a_mean": 181.5}, {"border_b_std": 35.5}, {"center_b_mean": 79.0}]
    rows = [tuple({**base, **c}[f] for f in wanted) for c in changes]
    ddl = ", ".join(f"{f} double" for f in wanted)
    assert values(spark, rows, ddl, realism.realism_reason()) == [
        "ok", "border_non_skin_hue=100", "ok", "too_dark=24", "magenta_cast_a=182", "patchy_b_std=36", "center_blue_b=79"]


def test_patch_positions_on_larger_images(spark):
    h, w = 100, 120
    full = [True] * (h * w)
    centre = [abs(y - 50) <= 12 and abs(x - 60) <= 44 for y in range(h) for x in range(w)]
    df = spark.createDataFrame([("full", full), ("centre", centre), ("none", [False] * (h * w))], "n string, mask array<boolean>")
    spots = realism.patch_positions(F.col("mask"), F.lit(h), F.lit(w), patch=16, margin=10)
    got = {r["n"]: [(s["y"], s["x"]) for s in r["s"]] for r in df.select("n", spots.alias("s")).collect()}
    edges = [(10, 10), (10, 52), (10, 94), (42, 10), (42, 94), (74, 10), (74, 52), (74, 94)]
    assert got["full"] == edges and got["none"] == edges
    assert got["centre"] == [(42, 87), (42, 17)]  # edge patches are too empty, two spots of the circle are not
    for y, x in got["centre"]:
        cells = [centre[(y + i) * w + x + j] for i in range(16) for j in range(16)]
        assert sum(cells) / 256 >= 0.95


def test_consensus_of_small_groups(spark):
    rows = [("one", 5.0), ("out", 1.0), ("out", 1.1), ("out", 1.2), ("out", 1.3), ("out", 50.0), ("gone", None), ("gone", float("nan"))]
    got = {r["k"]: r for r in realism.robust_consensus(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (got["one"]["median"], got["one"]["std"], got["one"]["kept"]) == (5.0, 0.0, 1)
    assert got["out"]["kept"] == 4 and got["out"]["n"] == 5 and got["out"]["median"] == pytest.approx(1.15)
    assert "gone" not in got


def test_required_columns_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string")
    assert [r["x"] for r in nan_to_null(df).collect()] == [None, 1.0]
    with pytest.raises(MissingColumnsError):
        require_columns(df, ["x", "y"])


def test_metadata_and_bridge(spark):
    items = spark.createDataFrame([("a",), ("b",)], "image_id string")
    meta = spark.createDataFrame([("a", "s2"), ("a", "s1")], "image_id string, site string")
    got = {r["image_id"]: r["site"] for r in joins.add_metadata(items, meta, "image_id", ["site", "no"], {"site": "UNKNOWN"}).collect()}
    assert got == {"a": "s1", "b": "UNKNOWN"}
    bridge = spark.createDataFrame([("a", "t1"), ("a", "t1")], "isic_id string, tag_id string")
    ratings = spark.createDataFrame([("t1", 1, 2), ("t1", 1, 2), ("t1", 3, None)], "tag_id string, mst_r1 int, mst_r2 int")
    assert joins.bridge_raters(items.withColumnRenamed("image_id", "isic_id"), bridge, ratings).count() == 2


def test_audit_keeps_zero_classes_and_names_null_sources(spark):
    df = spark.createDataFrame([("Light", "A", "x"), ("Light", "B", None), (None, "A", "x")], "s string, c string, src string")
    got = {(r["s"], r["class"]): (r["n"], r["count"], r["pct"])
           for r in audit.class_composition(df, "s", "c", ["A", "Z"], ["Light", "Dark"]).collect()}
    assert got[("Light", "A")] == (2, 1, 50.0) and got[("Dark", "A")] == (0, 0, 0.0) and got[("Overall", "Z")] == (3, 0, 0.0)
    src = {(r["s"], r["source"]): r["count"] for r in audit.source_composition(df, "s", "src", ["Light", "Dark"]).collect()}
    assert src == {("Light", "x"): 1, ("Light", "UNKNOWN"): 1, ("Overall", "x"): 2, ("Overall", "UNKNOWN"): 1}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    got = {r["bin"]: r["n"] for r in audit.confidence_histogram(df.withColumn("g", F.lit(1)), ["g"], "v", 4).collect()}
    assert got == {0: 1, 2: 1, 3: 1}
