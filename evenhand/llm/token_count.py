"""Token counts: batches of bounded bytes, lengths only.

A text is split at ASCII white space, where the tokenizer starts anew in any case,
so the number of tokens of a text is the sum over its words. The distinct words of
a batch are encoded by the library in one call, and only their lengths leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.texts import bounded_batches, byte_groups, coded_words

KNOWN_WORDS = 1 << 20  # lengths kept between batches by one worker; beyond that they are found anew
KEPT_LENGTH = 64  # characters of the longest word whose length is kept, so that what is kept is bounded in bytes


def word_lengths(tokenizer, words: pa.Array, known: dict[str, int]) -> np.ndarray:
    """Tokens of each word; ``known`` carries lengths over from batch to batch."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    listed = words.to_pylist()
    found = np.fromiter((known.get(w, -1) for w in listed), np.int64, len(listed))
    new = np.flatnonzero(found < 0)
    for start in range(0, len(new), 20_000):
        at = new[start:start + 20_000].tolist()
        block = [listed[i] for i in at]
        found[at] = [len(e) for e in tokenizer.encode_batch_fast(block, add_special_tokens=False)]
        known.update((w, n) for w, n in zip(block, found[at].tolist()) if len(w) <= KEPT_LENGTH)
    return found


def token_counts(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of ``docs``.

    ``tokenizer_file`` is the path of a ``tokenizers`` JSON file whose pre-tokenizer
    always breaks at white space and drops it; all machines must have it. Special
    strings inside a text count as the library's default does, nothing is added,
    truncated or padded. A null or empty text has 0 bytes and 0 tokens; repeated rows
    are counted one by one; an empty table gives an empty table; other columns are
    not read, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1)
            tokens = np.zeros(len(texts), np.int64)
            for rows, group in byte_groups(texts):
                words, codes, at = coded_words(group)
                lengths = word_lengths(tokenizer, words, known)
                sums = np.bincount(at, weights=lengths[codes], minlength=len(rows)).astype(np.int64)
                np.add.at(tokens, rows, sums)
            n_bytes = pc.binary_length(pc.fill_null(texts, "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens)],
                                             ["_key", "n_bytes", "n_tokens"])

    kind = narrow.schema["_key"].dataType.simpleString()
    return narrow.mapInArrow(count, f"_key {kind}, n_bytes long, n_tokens long").withColumnRenamed("_key", key)
