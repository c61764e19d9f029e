"""Language identification: known words first, then ever shorter character n-grams.

Words of labelled texts give one log frequency per language. A word that was not
seen is scored by its longest character n-grams that were; if none of one length is
known, the next shorter length is tried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.hashing import hash32
from evenhand.llm.texts import bounded_batches, byte_groups, coded_words, lean, pass_on, with_carried
from evenhand.session import reliable_checkpoint

LONGEST = 5  # characters of the longest n-gram; a word has one mark at each end
UNKNOWN = "und"
SCORES_KEPT = 1 << 19  # scores of unseen words kept between batches by one worker
KEPT_LENGTH = 64  # characters of the longest word whose score is kept, so that what is kept is bounded in bytes


def labelled_sample(docs: DataFrame, key: str, lang: str, most: int, seed: int = 42) -> DataFrame:
    """All rows if there are at most ``most``, else rows chosen by a hash of the key, language by language.

    Every language has an equal share of ``most``, and what small languages leave goes to
    the others: a language below its share keeps all of its rows. One row a language
    reaches the driver.
    """
    counts = sorted((r.n, r.lang) for r in docs.groupBy(F.col(lang).cast("string").alias("lang")).agg(
        F.count(F.lit(1)).alias("n")).collect())
    if sum(n for n, _ in counts) <= most:
        return docs
    left, rates = most, {}
    for place, (n, name) in enumerate(counts):
        taken = min(n, left / (len(counts) - place))
        rates[name] = taken / n
        left -= taken
    cut = F.element_at(F.create_map(*[F.lit(x) for name, rate in rates.items() for x in (name, int(2 ** 32 * rate))]),
                       F.col(lang).cast("string"))
    return docs.where(hash32(F.col(key), seed=seed) < cut)


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased texts in which everything but letters and their marks is a space."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """:func:`coded_words` of the letters; a word of marks alone is none."""
    words, codes, at = coded_words(letters(texts))
    filled = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    if filled.all():
        return words, codes, at
    kept = filled[codes]
    return words.filter(pa.array(filled)), (np.cumsum(filled) - 1)[codes[kept]], at[kept]


def language_words(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of the labelled texts, counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            of_row = coded.indices.to_numpy()
            for rows, group in byte_groups(batch.column(0)):
                words, codes, at = letter_words(group)
                pair = of_row[rows[at]].astype(np.int64) * len(words) + codes
                both, n = np.unique(pair, return_counts=True)
                lang_of, word_of = np.divmod(both, max(len(words), 1))
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(lang_of)), words.take(pa.array(word_of)), pa.array(n)],
                    ["lang", "word", "n"])

    counted = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(
        lean(count), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_grams(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, size, gram, n) of the words with a mark at each end."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))

    def grams(size: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1))), lambda i: F.struct(
            F.lit(size).alias("size"), F.substring(marked, i, F.lit(size)).alias("gram")))
        return F.filter(some, lambda g: F.length(g["gram"]) == size)  # a word that is too short has none

    exploded = words.select("lang", F.inline(F.flatten(F.array(*[grams(s) for s in range(1, longest + 1)]))), "n")
    return exploded.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Profile:
    """Log frequencies by language; row 0 of ``table`` is for nothing known."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]


def profile(labelled: DataFrame, text: str, lang: str, bound: int) -> Profile:
    """Fit the words and n-grams that make up at least 1 / ``bound`` of a language's words or n-grams.

    So at most ``bound`` words and ``bound`` n-grams of each length are held per language.
    """
    bounded_batches(labelled.sparkSession)
    words = reliable_checkpoint(language_words(labelled, text, lang).withColumn("size", F.lit(0)), "language-words")
    grams = word_grams(words.select("lang", "word", "n"))
    cells = reliable_checkpoint(
        words.select("lang", "size", F.col("word").alias("gram"), "n").unionByName(grams), "language-grams")
    totals = {(r.lang, r["size"]): (r.n, r.kinds) for r in cells.groupBy("lang", "size").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return Profile([], np.zeros(0), np.zeros((1, 0), np.float32), {}, {})
    limit = F.map_from_arrays(F.array(*[F.lit(f"{a}\x00{b}") for a, b in totals]),
                              F.array(*[F.lit(n // bound) for n, _ in totals.values()]))
    kept = cells.where(F.col("n") > limit[F.concat_ws("\x00", "lang", "size")]).select("lang", "size", "gram", "n")
    at = {name: i for i, name in enumerate(languages)}
    ids: tuple[dict[str, int], dict[str, int]] = {}, {}
    found = [(ids[r["size"] > 0].setdefault(f"{r['size']}{r.gram}", len(ids[r["size"] > 0])), r["size"], at[r.lang], r.n)
             for r in kept.toLocalIterator()]
    n_words = len(ids[0])
    table = np.zeros((1 + n_words + len(ids[1]), len(languages)))
    for i, size, column, n in found:
        table[1 + i + (n_words if size else 0), column] = n
    sizes = np.zeros(len(table), np.int64)
    for name, i in ids[1].items():
        sizes[1 + n_words + i] = int(name[0])
    total = np.array([[totals.get((a, s), (0, 0))[0] for a in languages] for s in range(LONGEST + 1)], float)
    kinds = np.array([max(totals.get((a, s), (0, 0))[1] for a in languages) for s in range(LONGEST + 1)], float)
    table = np.log((table + 0.5) / (total[sizes] + 0.5 * kinds[sizes][:, None] + 1))
    table[0] = 0
    prior = np.array([totals.get((a, 0), (0, 0))[0] for a in languages], float)
    return Profile(languages, prior / prior.sum(), table.astype(np.float32),
                   {k[1:]: 1 + i for k, i in ids[0].items()}, {k: 1 + n_words + i for k, i in ids[1].items()})


class Scorer:
    """Scores of distinct words; those of unseen words are kept between batches."""

    def __init__(self, model: Profile):
        self.model = model
        self.grams = [{k[1:]: i for k, i in model.grams.items() if k[0] == str(s)} for s in range(LONGEST + 1)]
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.scores = self.model.table[:0]

    def rows(self, word: str) -> list[int]:
        """Rows of the longest n-grams that are known, row 0 if none is."""
        marked = f"^{word}$"
        for size in range(min(LONGEST, len(marked)), 0, -1):
            known = self.grams[size]
            inner = marked if size > 1 else word  # the marks alone say nothing
            rows = [known[g] for s in range(len(inner) - size + 1) if (g := inner[s:s + size]) in known]
            if rows:
                return rows
        return [0]

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words by language; for unseen words the mean of their n-grams."""
        known = self.model.words
        rows = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        scores = self.model.table[rows]
        if len(self.scores) > SCORES_KEPT:
            self.forget()
        unseen = np.flatnonzero(rows == 0)
        new = [w for i in unseen.tolist() if (w := words[i]) not in self.kept]
        place = dict(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        if new:
            found = [self.rows(w) for w in new]
            sizes = np.array([len(f) for f in found])
            flat = self.model.table[np.concatenate([np.array(f) for f in found])]
            means = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            self.kept.update((w, i) for w, i in place.items() if len(w) <= KEPT_LENGTH)
            self.scores = np.concatenate([self.scores, means.astype(np.float32)])
        if len(unseen):
            scores[unseen] = self.scores[[place[w] if (w := words[i]) in place else self.kept[w] for i in unseen.tolist()]]
        return scores


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             max_rows: int = 50_000, bound: int = 30_000, confident_words: int = 10,
             carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., lang_pred, score) for every row of ``docs``.

    Learns from the texts and languages of ``labelled`` alone: all of its rows or, by a
    hash of the key, about ``max_rows`` of them, with all rows of small languages; rows
    without text or language teach nothing. The prediction is the language of the largest sum over words, ties to the
    smaller name; a text of letters of which nothing is known gets the most common
    language. ``score`` is its share after a softmax of the mean score of a word,
    sharpened by the number of words up to ``confident_words``. Texts that are null,
    empty or without letters (marks are none) get ``und`` and the score 0, and so does every text if
    nothing could be learned. Repeated rows are judged one by one; empty tables give
    empty tables; columns outside ``carry`` are not read.
    """
    taught = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    model = profile(labelled_sample(taught.select(key, text, lang), key, lang, max_rows), text, lang, bound)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        fitted = scorer.model
        width = len(fitted.languages)

        def judge(batch: pa.RecordBatch) -> list:
            sums = np.zeros((batch.num_rows, width))
            n = np.zeros(batch.num_rows, np.int64)
            for rows, group in byte_groups(batch.column(0)):
                words, codes, at = letter_words(group)
                scores = scorer.words(words.to_pylist())
                for k in range(width):
                    np.add.at(sums[:, k], rows, np.bincount(at, weights=scores[codes, k], minlength=len(rows)))
                np.add.at(n, rows, np.bincount(at, minlength=len(rows)))
            none = (n == 0) | (width == 0)
            share = np.zeros(batch.num_rows)
            best = np.zeros(batch.num_rows, np.int64)
            if width:
                flat = np.ptp(sums, axis=1) == 0
                sums[flat] += np.log(fitted.prior)
                mean = sums / np.maximum(n, 1)[:, None]
                power = np.minimum(n, confident_words)[:, None] * (mean - mean.max(axis=1, keepdims=True))
                share = 1 / np.exp(power).sum(axis=1)
                best = sums.argmax(axis=1)
            names = [UNKNOWN if u else fitted.languages[best[i]] for i, u in enumerate(none)]
            return [pa.array(names, pa.string()), pa.array(np.where(none, 0.0, share))]

        return judge

    return pass_on(with_carried(docs, key, text, carry), start, {"lang_pred": "string", "score": "double"}, key, text, carry)
