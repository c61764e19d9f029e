"""Gate stages, scores, pairs and chat records on hand-made texts."""

import json

import pytest
from pyspark.sql import functions as F

from evenhand.functions import text as tx
from evenhand.functions.text import Lexicon
from evenhand.operators import gate, preference

GOOD = ("The dermoscopic view of the upper area suggests melanoma with pigment asymmetry, consistent with the "
        "findings; clinical review is recommended. ") + "word " * 50
SCHEMA = "image_id string, teacher_reasoning string, predicted_class string, gradcam_spatial_region string"


def gated(spark, rows, lexicon=Lexicon(), **kw):
    df = gate.gate(gate.run_checks(spark.createDataFrame(rows, SCHEMA), lexicon, **kw))
    return {r["image_id"]: r for r in df.collect()}


def test_each_stage_fails_alone_and_first_failure_names_the_reason(spark):
    rows = [
        ("ok", GOOD, "mel", "upper"),
        ("keywords", GOOD.replace("melanoma", "x").replace("pigment", "y").replace("asymmetry", "z").replace("dermoscopic", "d"), "mel", "upper"),
        ("indet", GOOD + " not visible", "mel", "upper"),
        ("region", GOOD, "mel", "lower-left"),
        ("short", "melanoma pigment asymmetry clinical", "mel", "upper"),
        ("long", GOOD + "word " * 200, "mel", "upper"),
        ("definitive", GOOD + " no doubt", "mel", "upper"),
        ("unhedged", GOOD.replace("consistent with", "like").replace("clinical", "c").replace("recommended", "r"), "mel", "upper"),
        ("both", "indeterminate", "mel", "upper"),
        ("blank", "   ", "mel", "upper"),
    ]
    got = gated(spark, rows)
    reasons = {k: r["reason"] for k, r in got.items()}
    assert reasons == {
        "ok": None, "keywords": "keyword_fail", "indet": "indeterminate", "region": "spatial_misalign",
        "short": "length_fail", "long": "length_fail", "definitive": "safety_fail", "unhedged": "safety_fail",
        "both": "keyword_fail", "blank": "keyword_fail"}
    assert got["ok"]["qc_metadata"]["spatial_status"] == "spatial references aligned"
    assert got["ok"]["qc_metadata"]["word_count"] == len(GOOD.split())
    assert got["region"]["detail"] == 'Text says "upper" but Grad-CAM shows "lower-left"'
    assert got["definitive"]["detail"] == "contains definitive diagnostic language"
    assert got["unhedged"]["detail"] == "missing hedging/safety language"
    assert got["indet"]["detail"] == "not visible"
    assert got["blank"]["word_count"] == 0
    assert "expected melanoma" in got["both"]["detail"]  # the list in force is reported


def test_region_rules(spark):
    rows = [(n, t, "mel", r) for n, t, r in [
        ("diffuse", "upper lower", "diffuse"), ("absent", "upper", None), ("no_claim", "nothing said", "lower"),
        ("own_side", "lower and upper", "upper-left"), ("opposite", "right", "left"), ("centre", "central", "lower"),
        ("substring", "bright", "left")]]
    got = gated(spark, rows)
    assert {k: r["pass_spatial"] for k, r in got.items()} == {
        "diffuse": True, "absent": True, "no_claim": True, "own_side": False, "opposite": False, "centre": True,
        "substring": False}
    strict = gated(spark, rows, Lexicon(word_boundary=True))
    assert strict["substring"]["pass_spatial"] and not strict["opposite"]["pass_spatial"]


def test_listed_keywords_win_and_unknown_class_uses_default(spark):
    df = spark.createDataFrame(
        [("a", "Alpha beta", "mel", "upper", ["ALPHA", "beta"]), ("b", "skin lesion", "other", "upper", None)],
        SCHEMA + ", expected_keywords array<string>")
    got = {r["image_id"]: r for r in gate.run_checks(df, listed="expected_keywords").collect()}
    assert got["a"]["keywords_matched"] == ["ALPHA", "beta"] and got["a"]["pass_keywords"]
    assert got["b"]["keywords_matched"] == ["lesion", "skin"]
    assert got["b"]["keywords_expected"] == tx.DEFAULT_KEYWORDS


def test_word_count_follows_unicode_white_space(spark):
    samples = ["", " ", "a b", "a b", "a b\tc\nd", "a\x1fb", "　a "]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(tx.word_count(F.col("t"))).collect()] == [len(s.split()) for s in samples]


def candidates(spark, specs):
    """One item with texts that fail exactly the named checks."""
    flags = {f"pass_{c}": None for c in gate.CHECKS}
    rows = [("i", n, f"text{n}", *[c not in fails for c in gate.CHECKS]) for n, fails in enumerate(specs)]
    df = spark.createDataFrame(rows, "item string, ordinal int, body string, " + ", ".join(f"{f} boolean" for f in flags))
    return df.withColumns({
        "keywords_matched": F.array(F.lit("k")), "spatial_status": F.lit("s"), "word_count": F.lit(1),
        "safety_problem": F.lit(None).cast("string")})


def test_gap_rule_is_exact_with_decimals_and_short_with_floats(spark):
    rows = candidates(spark, [[], ["indeterminate", "length"]])
    exact = preference.preference_pairs(preference.score_candidates(rows), ["item"], "ordinal", "body")
    assert exact.count() == 1
    floats = preference.preference_pairs(preference.score_candidates(rows, float_scores=True), ["item"], "ordinal", "body")
    assert floats.count() == 0


def test_ties_keep_candidate_order(spark):
    rows = candidates(spark, [["length"], [], [], ["length"], ["length", "safety"], ["length", "safety"]])
    pair = preference.preference_pairs(preference.score_candidates(rows), ["item"], "ordinal", "body").first()
    assert (pair["chosen"], pair["rejected"]) == ("text1", "text5")
    assert str(pair["chosen_score"]) == "1.00" and str(pair["rejected_score"]) == "0.65"


def test_published_shares(spark):
    """70 and 67 of 74 passed, 1 / 4 / 69 wins, losses and ties."""
    rows = [(f"i{n}", n < 70, n < 67) for n in range(74)]
    df = spark.createDataFrame(rows, "item string, a boolean, b boolean")

    def checked(col):
        extra = {f"pass_{c}": F.lit(True) for c in gate.CHECKS[1:]}
        return df.select("item", F.lit("x").alias("predicted_class"), F.lit(1).alias("word_count"),
                         F.col(col).alias("pass_keywords")).withColumns(extra)

    rate_a = gate.class_pass_rates(checked("a")).first()["rate"]
    rate_b = gate.class_pass_rates(checked("b")).first()["rate"]
    assert round(rate_a * 100, 1) == 94.6 and round(rate_b * 100, 1) == 90.5
    outcome = {r["outcome"]: r["n"] for r in gate.head_to_head(checked("a"), checked("b"), ["item"]).collect()}
    assert outcome == {"a": 3, "b": 0, "tie": 71}


def test_chat_messages_and_prompt(spark):
    df = spark.createDataFrame([(
        "i1", "/a.jpg", "/a_overlay.jpg", "Melanoma", 0.875, {"nv": 0.1, "mel": 0.875, "bcc": 0.025}, "upper", "strong",
        "Because.", True)], "image_id string, image_path string, gradcam_overlay_path string, predicted_name string, "
        "confidence double, all_scores map<string,double>, gradcam_spatial_region string, gradcam_intensity string, "
        "teacher_reasoning string, cnn_correct boolean")
    messages = preference.create_conversations(df).first()["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "assistant"]
    assert [p["type"] for p in messages[1]["content"]] == ["image", "image", "text"]
    prompt = messages[1]["content"][2]["text"]
    assert prompt.index("- mel: 87.5%") < prompt.index("- nv: 10.0%") < prompt.index("- bcc: 2.5%")
    assert "**Confidence Score:** 87.5%\n" in prompt and "upper (intensity: strong)" in prompt
    assert messages[2]["content"][0]["text"] == "Because."
    teacher = df.select(preference.teacher_prompt()).first()[0]
    assert "Ground Truth:** Yes" in teacher and "Primary activation region: upper" in teacher


def test_training_pairs_serialise_the_prompt(spark):
    auto = spark.createDataFrame([([("user", "hi")], "good", "bad")],
                                 "prompt array<struct<role: string, content: string>>, chosen string, rejected string")
    row = preference.training_pairs(auto).first()
    assert json.loads(row["prompt"]) == [{"role": "user", "content": "hi"}]


@pytest.mark.parametrize("label,expected", [("MEL ", "melanoma"), ("nv", "nevus")])
def test_class_lists_ignore_case_and_blanks(spark, label, expected):
    df = spark.createDataFrame([(label,)], "c string")
    assert df.select(tx.expected_keywords(F.col("c"), Lexicon())).first()[0][0] == expected


def test_percentages_are_rounded_like_exact_decimals(spark):
    from evenhand.operators.preference import indented_json, percent

    shares = [i / 10_000 for i in range(10_001)] + [0.0225, 0.00125, 0.00375, 1 / 3, 0.99949999, 0.9995, 1.0, 12.3456]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "i int, s double")
    got = {r["i"]: r["t"] for r in rows.select("i", percent(F.col("s")).alias("t")).collect()}
    assert [got[i] for i in range(len(shares))] == [f"{s * 100:.1f}%" for s in shares]
    scores = {"a": 0.0001, "b": 0.5, "c": 0.0, 'd"': 1.0, "e": 0.0123}
    in_order = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    none = F.map_filter(in_order, lambda k, v: v < 0)
    text = spark.range(1).select(indented_json(in_order), indented_json(none)).first()
    assert list(text) == [json.dumps(scores, indent=2), "{}"]


def test_a_null_text_is_an_empty_text(spark):
    from evenhand.operators import gate

    rows = spark.createDataFrame([(1, None, "mel", "upper"), (2, "", "mel", "upper")],
                                 "image_id int, teacher_reasoning string, predicted_class string, gradcam_spatial_region string")
    checked = gate.run_checks(rows)
    flags = [[r[f"pass_{c}"] for c in gate.CHECKS] + [r["word_count"], r["safety_problem"]] for r in checked.collect()]
    assert flags[0] == flags[1] and flags[0][-2] == 0 and flags[0][4] is False


def test_overlay_keeps_one_row_per_key(spark):
    from evenhand.operators.joins import overlay

    left = spark.createDataFrame([("k", 1), ("k", 2), ("x", 3)], "key string, n int")
    right = spark.createDataFrame([("k", "b"), ("k", "a")], "key string, c string")
    got = overlay(left, right, "key", ["c"], {"c": F.lit("none")}).orderBy("n").collect()
    assert [(r["n"], r["c"]) for r in got] == [(1, "a"), (2, "a"), (3, "none")]
