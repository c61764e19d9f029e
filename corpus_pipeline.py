"""Cleaning and mixing a corpus: stages of the training-data operators, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.bpe import encode
from evenhand.llm.language import UNKNOWN, identify
from evenhand.llm.mixing import emit_mix
from evenhand.llm.near_texts import WORDS, copy_classes, set_prints
from evenhand.llm.queries import toxic_labels
from evenhand.llm.registry import table, tokenizer_file
from evenhand.llm.simhash import keep_first
from evenhand.llm.texts import remainder, sheltered
from evenhand.llm.toxicity import score
from evenhand.session import reliable_checkpoint

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


LEAST_LANGUAGE_SCORE = 0.5
TOXIC_FROM = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of 0.5 or more; texts without letters go.

    Columns of ``docs`` pass through every stage but the last, whatever their names.
    """
    given, restored = sheltered(docs, ("doc_id", "text", "lang"))
    judged = identify(given, given.where(remainder("doc_id", 4) != 2), carry=given.columns)
    return restored(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.5."""
    given, restored = sheltered(docs, ("doc_id", "text"))
    judged = score(given, toxic_labels(spark, sf_dir, given), max_examples=24_000, carry=given.columns)
    return restored(judged.where(F.col("score") < TOXIC_FROM))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of texts that share 0.8 or more of their 5-word shingles.

    SimHash fingerprints, and minimum hashes beyond their radius, find what is compared; shingle sets decide.
    """
    return keep_first(docs, copy_classes(docs), shingle=WORDS, prints=set_prints)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources at the weights 1, 2, 3 takes them."""
    return emit_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the token ids of every whole text and a digest of what they decode to."""
    coded = encode(docs, tokenizer_file(), carry=("lang", "source"), packed=False, decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
