"""Chat records and preference pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evenhand.functions.text import EXPECTED_KEYWORDS
from evenhand.operators.gate import passes_all, response_score, score_details
from evenhand.operators.joins import union_pairs
from evenhand.schemas import CLASSIFIER_RECORD

# Fixed value: system message of the chat records.
SYSTEM_MESSAGE = (
    "You are a clinical AI assistant trained to interpret dermoscopic images "
    "alongside CNN classification outputs and Grad-CAM heatmaps. You provide "
    "concise, evidence-based diagnostic reasoning. You never make definitive "
    "diagnoses. You always recommend clinical correlation."
)
# The prompt texts around the classifier output.
PROMPT_HEAD = (
    "You are analyzing a dermoscopic skin lesion image. "
    "A CNN classifier (EfficientNetV2B2) has produced the following output:\n\n"
)
PROMPT_TAIL = (
    "\nThe first image is the original dermoscopic photograph. "
    "The second image is the Grad-CAM heatmap overlay showing which "
    "regions the CNN focused on for its classification.\n\n"
    "Provide a concise diagnostic reasoning paragraph interpreting "
    "these findings for a clinician."
)
# What a reviewer is asked to judge.
REVIEW_CRITERIA = ["safety", "accuracy", "spatial_fidelity", "completeness", "conciseness"]

_PART = T.StructType().add("type", "string").add("image", "string").add("text", "string")


def percent(value: Column) -> Column:
    """One-decimal percentage text of a share of 0 or more, rounded from the exact binary value, ties to even.

    Only the fraction is rounded. It is cut in two parts that multiply without error,
    so the comparison with the middle of two tenths is exact.
    """
    def tenths(n: Column) -> Column:
        whole, fraction = F.floor(n), n - F.floor(n)
        high = F.floor(fraction * 2 ** 26) / 2 ** 26
        low = fraction - high
        digit = F.floor(fraction * 10)
        above, below = high * 20 - (2 * digit + 1), low * -20
        up = (above > below) | ((above == below) & (digit % 2 == 1))
        return whole * 10 + digit + F.when(up, 1).otherwise(0)

    count = tenths(value.cast("double") * 100)
    return F.concat(F.floor(count / 10).cast("bigint").cast("string"), F.lit("."), (count % 10).cast("string"), F.lit("%"))


def number_text(value: Column) -> Column:
    """Shortest text of a number, without an exponent for numbers from 0.0001 up."""
    text = value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when((F.abs(value) < 0.001) & (F.abs(value) >= 0.0001), plain).otherwise(text)


def indented_json(scores: Column) -> Column:
    """A class -> score map as JSON with an indent of two, in the order of the map."""
    lines = F.transform(F.map_entries(scores), lambda e: F.concat(
        F.lit("  "), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2),
        F.lit(": "), number_text(e["value"])))
    return F.when(F.size(scores) == 0, F.lit("{}")).otherwise(
        F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def ranked_scores(scores: Column) -> Column:
    """Entries of a class -> score map, highest first; equal scores by class name."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct(
        (-e["value"]).alias("k"), e["key"].alias("class"), e["value"].alias("score")))
    return F.array_sort(entries)


def user_prompt() -> Column:
    """Prompt text of a classifier record, class scores in descending order."""
    lines = F.transform(ranked_scores(F.col("all_scores")), lambda e: F.concat(
        F.lit("  - "), e["class"], F.lit(": "), percent(e["score"]), F.lit("\n")))
    # The wording between the fields.
    return F.concat(
        F.lit(PROMPT_HEAD),
        F.lit("**Predicted Classification:** "), F.col("predicted_name"), F.lit("\n"),
        F.lit("**Confidence Score:** "), percent(F.col("confidence")), F.lit("\n"),
        F.lit("**Grad-CAM Focus Region:** "), F.col("gradcam_spatial_region"),
        F.lit(" (intensity: "), F.col("gradcam_intensity"), F.lit(")\n\n**All Class Probabilities:**\n"),
        F.array_join(lines, ""), F.lit(PROMPT_TAIL),
    )


def teacher_prompt() -> Column:
    """Prompt text for the reasoning model, with the scores as JSON."""
    # The wording between the fields.
    return F.concat(
        F.lit("Analyze this dermoscopic image with the following CNN classification output:\n\n"),
        F.lit("**Predicted Diagnosis:** "), F.col("predicted_name"), F.lit("\n"),
        F.lit("**Confidence Score:** "), percent(F.col("confidence")), F.lit("\n"),
        F.lit("**CNN Correct vs Ground Truth:** "), F.when(F.col("cnn_correct"), "Yes").otherwise("No"),
        F.lit("\n\n**Top differential scores:**\n"), indented_json(F.col("all_scores")),
        F.lit("\n\n**Grad-CAM Analysis:**\n- Primary activation region: "), F.col("gradcam_spatial_region"),
        F.lit("\n- Activation intensity: "), F.col("gradcam_intensity"),
        F.lit("\n\nThe first image is the original dermoscopic image.\n"
              "The second image is the Grad-CAM overlay showing which regions the CNN focused on.\n\n"
              "Provide a concise diagnostic reasoning paragraph."),
    )


def _part(kind: str, value: Column) -> Column:
    none = F.lit(None).cast("string")
    image, text = (value, none) if kind == "image" else (none, value)
    return F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))


def message(role: str, parts: Sequence[Column]) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def chat_messages(
    user_text: Column, answer: Column, images: Sequence[Column] = (), system: str = SYSTEM_MESSAGE
) -> Column:
    """System, user (images and text) and assistant messages of one record.

    A plain string content is stored as one text part, so that all messages share
    one schema.
    """
    return F.array(
        message("system", [_part("text", F.lit(system))]),
        message("user", [*[_part("image", i) for i in images], _part("text", user_text)]),
        message("assistant", [_part("text", answer)]),
    )


def create_conversations(
    records: DataFrame, text: str = "teacher_reasoning", carry: Sequence[str] = ()
) -> DataFrame:
    """(image_id, carry..., messages) of gated records, row by row."""
    images = [F.col("image_path"), F.col("gradcam_overlay_path")]
    return records.select("image_id", *carry, chat_messages(user_prompt(), F.col(text), images).alias("messages"))


def prompt_messages(messages: Column) -> Column:
    """System and user message: what an answer is asked for."""
    return F.slice(messages, 1, 2)


def classifier_records(
    scored: DataFrame, names: Mapping[str, str], keywords: Mapping[str, Sequence[str]] = EXPECTED_KEYWORDS,
    folder: str = "", decimals: int = 4,
) -> DataFrame:
    """Records of ``CLASSIFIER_RECORD`` from scores and heat-map words, with the class's expected keywords.

    ``scored`` has (image_id, image_path, ground_truth, all_scores, gradcam_spatial_region,
    gradcam_intensity). The predicted class has the highest score, ties to the first of the
    map; scores are rounded after that. Keywords are NULL for a class without a list.
    """
    entries = F.map_entries("all_scores")
    top = F.array_max(F.map_values("all_scores"))
    first = F.filter(entries, lambda e: e["value"] == top)[0]["key"]
    lists = F.create_map(*[x for c, words in keywords.items() for x in (F.lit(c), F.array(*[F.lit(w) for w in words]))])
    full = F.create_map(*[x for c, n in names.items() for x in (F.lit(c), F.lit(n))])
    place = F.concat(F.lit(f"{folder}/gradcam/" if folder else "gradcam/"), F.col("image_id"))
    built = scored.withColumn("predicted_class", first).withColumns({
        "predicted_name": full[F.col("predicted_class")], "expected_keywords": lists[F.col("predicted_class")],
        "confidence": F.round(top, decimals),
        "all_scores": F.transform_values("all_scores", lambda _, v: F.round(v, decimals)),
        "cnn_correct": F.col("predicted_class") == F.col("ground_truth"),
        "gradcam_overlay_path": F.concat(place, F.lit("_overlay.jpg")),
        "gradcam_npy_path": F.concat(place, F.lit("_gradcam.npy")),
    })
    return built.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLASSIFIER_RECORD.fields])


def score_candidates(checked: DataFrame, float_scores: bool = False) -> DataFrame:
    """Checked candidate texts with score, pass-all flag and details."""
    return checked.withColumns({
        "score": response_score(float_scores), "passed": passes_all(), "details": score_details(),
    })


def best_and_worst(scored: DataFrame, key: Sequence[str], ordinal: str, text: str) -> DataFrame:
    """(key, best, worst): highest and lowest score of each item's candidates.

    Stable descending order: of equal scores the earliest is best and the latest is
    worst. Two aggregates, so candidates are never gathered in one list.
    """
    candidate = F.struct(F.col(text).alias("text"), "score", "details", F.col(ordinal).alias("ordinal"))
    return scored.groupBy(*key).agg(
        F.max_by(candidate, F.struct(F.col("score"), -F.col(ordinal))).alias("best"),
        F.min_by(candidate, F.struct(F.col("score"), -F.col(ordinal))).alias("worst"),
    )


def preference_pairs(
    scored: DataFrame, key: Sequence[str], ordinal: str, text: str,
    min_gap: str = "0.20", target: int | None = None,
) -> DataFrame:
    """Best against worst candidate where the gap suffices; first ``target`` items by key."""
    ends = best_and_worst(scored, key, ordinal, text)
    gap = F.col("best.score") - F.col("worst.score")
    kind = dict(scored.dtypes)["score"]
    needed = F.lit(min_gap).cast("double" if kind == "double" else "decimal(3,2)")
    pairs = ends.where(gap >= needed).select(
        *key, F.col("best.text").alias("chosen"), F.col("worst.text").alias("rejected"),
        F.col("best.score").alias("chosen_score"), F.col("worst.score").alias("rejected_score"),
        F.col("best.details").alias("chosen_details"), F.col("worst.details").alias("rejected_details"),
        F.lit("automated").alias("source"),
    )
    return pairs if target is None else pairs.orderBy(*key).limit(target)


def first_records(df: DataFrame, ordinal: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*ordinal).limit(n)


def review_template(records: DataFrame, ordinal: Sequence[str], user_input: Column, n: int = 150) -> DataFrame:
    """First ``n`` records with empty fields for a reviewer; ``id`` counts from 0 over these ``n`` rows."""
    empty = F.lit("")
    top = first_records(records, ordinal, n)
    return top.select(
        (F.row_number().over(Window.orderBy(*ordinal)) - 1).alias("id"), user_input.alias("user_input"),
        empty.alias("model_response"), empty.alias("chosen"), empty.alias("rejected"),
        empty.alias("rejection_reason"),
        F.array(*[F.lit(c) for c in REVIEW_CRITERIA]).alias("alignment_criteria"),
    )


def training_pairs(
    automatic: DataFrame, manual: DataFrame | None = None, prompt: str = "prompt", carry: Sequence[str] = ()
) -> DataFrame:
    """(carry..., prompt, chosen, rejected) with the prompt messages as JSON text."""
    pairs = union_pairs(automatic, manual)
    value = F.col(prompt)
    if not isinstance(pairs.schema[prompt].dataType, T.StringType):
        value = F.to_json(value)
    return pairs.select(*carry, value.alias("prompt"), "chosen", "rejected")
