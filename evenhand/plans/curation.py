"""Curation job: gate, report, splits with chat records, and preference pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evenhand.functions.hashing import SEED
from evenhand.functions.text import Lexicon
from evenhand.operators import gate, preference, sampling
from evenhand.operators.joins import overlay
from evenhand.session import reliable_checkpoint


@dataclass(frozen=True)
class CuratedRecords:
    clean: DataFrame
    discarded: DataFrame
    report: DataFrame
    conversations: DataFrame


def curate_records(
    records: DataFrame, lexicon: Lexicon = Lexicon(), listed: str | None = "expected_keywords",
    holdout: Sequence[float] = (0.15, 0.333), names: Sequence[str] = ("train", "validation", "test"),
    minimum: int = 1500, seed: int = SEED,
) -> CuratedRecords:
    """Gate the records, report, split the clean ones by class and write them as chats.

    The gated table is written once, so the text is searched once.
    """
    checked = gate.run_checks(records, lexicon, listed=listed if listed in records.columns else None)
    columns = [*records.columns, "reason", "detail", "qc_metadata"]
    gated = reliable_checkpoint(gate.gate(checked).select(*columns), "gated")
    clean = gated.where(F.col("reason").isNull()).drop("reason", "detail")
    parts = sampling.stratified_split(clean, ["predicted_class"], "image_id", holdout, names, seed)
    chats = preference.create_conversations(parts, carry=["split"])
    return CuratedRecords(
        clean, gated.where(F.col("reason").isNotNull()).select("image_id", "predicted_class", "reason", "detail"),
        gate.gate_report(gated, minimum=minimum), chats,
    )


def build_pairs(
    candidates: DataFrame, metadata: DataFrame, key: str, ordinal: str, text: str,
    lexicon: Lexicon = Lexicon(), min_gap: str = "0.20", target: int | None = None, float_scores: bool = False,
    conversations: DataFrame | None = None, listed: str = "expected_keywords",
) -> DataFrame:
    """Score candidate texts against their record's metadata and keep best/worst pairs.

    Candidates without metadata are scored with class ``unknown`` and region ``center``.
    Where the metadata has a list of keywords in ``listed``, it wins over the class list.
    ``conversations`` (key, messages) give each pair its ``prompt``, the first two messages;
    pairs without a conversation have none. All pairs are kept unless ``target`` says how many.
    """
    columns = ["predicted_class", "gradcam_spatial_region", *([listed] if listed in metadata.columns else [])]
    joined = overlay(
        candidates, metadata, key, columns,
        {"predicted_class": F.lit("unknown"), "gradcam_spatial_region": F.lit("center")})
    checked = gate.run_checks(joined, lexicon, text=text, listed=listed if listed in joined.columns else None)
    pairs = preference.preference_pairs(
        preference.score_candidates(checked, float_scores), [key], ordinal, text, min_gap, target)
    if conversations is None:
        return pairs
    asked = conversations.groupBy(key).agg(F.min_by("messages", F.to_json("messages")).alias("messages"))
    prompt = preference.prompt_messages(F.col("messages")).alias("prompt")
    return pairs.join(asked, key, "left").select(*pairs.columns, prompt)
