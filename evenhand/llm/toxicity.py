"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Every word of a labelled example is a term. Its weight is its inverse document frequency,
raised for words that come more often with label 1 than chance would have it; no word is
left out. The examples lie in blocks of like texts. The index holds the weights of the
most frequent terms block by block with their largest values, and postings of all others.
A search adds up the postings, which are few, and bounds each block by them and by the
largest weights; blocks that cannot hold one of the nearest examples are skipped, so the
result is that of comparing with all examples. Votes weigh by nearness and are calibrated
on the examples themselves, each judged without those of its own key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from evenhand.functions.hashing import hash32
from evenhand.llm.language import letters
from evenhand.llm.texts import bounded_batches, coded_words, gather, lean, pass_on, spare_memory, with_carried
from evenhand.session import reliable_checkpoint

BLOCK = 64  # examples in a block of the index
DENSE = 512  # most frequent terms; their weights are kept for every example of a block
FIRST_BLOCKS = 4  # blocks of each text that are scored before any is skipped
QUERIES = 16  # texts that are searched together
POSTINGS = 1 << 18  # postings of a text that are added up together
SIGNS = 64  # frequent terms that tell which examples are alike
NEAREST = 15
TELLING = 2.0  # how much the log odds of label 1 raise a term's weight
BIN_ROWS = 20  # examples in a bin of the calibration
SHOWN = 10  # terms listed as evidence
LOADED = 500  # examples whose weights are computed together
LOOKED_UP = 1 << 17  # terms that are looked up together
BATCH_BYTES = 2 << 20  # of texts that a worker holds beside the index


# --- texts as vectors ----------------------------------------------------------


@dataclass
class Rows:
    """Terms of some texts: ``row`` rises; ``n`` is how often the term comes."""

    row: np.ndarray
    term: np.ndarray
    n: np.ndarray


def text_terms(texts: pa.Array) -> tuple[pa.Array, Rows]:
    """(distinct words, their numbers by text); a batch is bounded by bytes or holds one text."""
    words, codes, at = coded_words(letters(pc.fill_null(texts, "")))
    pair, n = np.unique(at * max(len(words), 1) + codes, return_counts=True)
    row, term = np.divmod(pair, max(len(words), 1))
    return words, Rows(row, term, n)


@dataclass
class Terms:
    """The terms of the examples, the most frequent first, and their weights."""

    names: pa.Array
    weights: np.ndarray
    unknown: float  # weight of a word that no example has

    @classmethod
    def of(cls, names: pa.Array, df: np.ndarray, hits: np.ndarray, n: int, ones: int) -> Terms:
        """From texts that have the term, those of label 1 among them, and the numbers of all examples."""
        idf = np.log((n + 1) / (df + 1)) + 1
        if 0 < ones < n:
            p = ones / n
            share = (hits + 2 * p) / (df + 2)
            idf = idf * (1 + TELLING * np.maximum(np.log(share / (1 - share)) - np.log(p / (1 - p)), 0))
        return cls(names, idf, float(np.log(n + 1) + 1))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each of the distinct ``words`` among the terms, -1 for others; the terms are many, so the words are hashed."""
        found = np.full(len(words), -1, np.int32)
        for first in range(0, len(self.names), LOOKED_UP):
            at = pc.index_in(self.names.slice(first, LOOKED_UP), value_set=words)
            terms = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            found[at.drop_null().to_numpy()] = first + terms
        return found

    def vectors(self, texts: pa.Array) -> Rows:
        """Known terms of each text with the weights ``n`` of its unit vector; unknown words count in its length."""
        words, rows = text_terms(texts)
        known = self.numbers(words)[rows.term]
        weight = (1 + np.log(rows.n)) * np.where(known < 0, self.unknown, self.weights[known] if len(self.weights) else 0)
        length = np.sqrt(np.bincount(rows.row, weights=weight * weight, minlength=len(texts)))
        kept = known >= 0
        return Rows(rows.row[kept], known[kept], (weight / length[rows.row])[kept])


# --- the index -------------------------------------------------------------------


@dataclass
class BlockMaxIndex:
    """Examples in blocks; terms below ``table``'s width are dense, the others have postings."""

    labels: np.ndarray
    keys: list
    place: np.ndarray  # order of each example among the keys, for ties
    table: np.ndarray  # [example, dense term]
    most: np.ndarray  # [dense term, block]
    starts: np.ndarray  # of the postings of each other term
    examples: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, parts: Callable[[], Iterator[Rows]], labels: Sequence[int], keys: Sequence, n_terms: int,
              dense: int | None = None) -> BlockMaxIndex:
        """From unit vectors of the examples in the order of their keys; ``parts`` gives some of them at a time, twice."""
        n, dense = len(keys), min(DENSE if dense is None else dense, n_terms)
        labels = np.asarray(labels, np.int64)
        sign = np.zeros((n, max(1, min(SIGNS, n_terms))), np.float32)
        starts = np.zeros(n_terms - dense + 1, np.int64)
        for rows in parts():
            frequent = rows.term < sign.shape[1]
            sign[rows.row[frequent], rows.term[frequent]] = rows.n[frequent]
            starts[1:] += np.bincount(rows.term[rows.term >= dense] - dense, minlength=n_terms - dense)
        np.cumsum(starts, out=starts)
        order = np.lexsort((np.arange(n), sign.argmax(axis=1), labels))
        at = np.empty(n, np.int32)
        at[order] = np.arange(n)
        blocks = -(-n // BLOCK)
        table = np.zeros((blocks * BLOCK, dense))
        examples, weights = np.zeros(starts[-1], np.int32), np.zeros(starts[-1])
        free = starts[:-1].copy()  # where the next posting of each term goes, so that none is held twice
        for rows in parts():
            inside = rows.term < dense
            table[at[rows.row[inside]], rows.term[inside]] = rows.n[inside]
            by_term = np.flatnonzero(~inside)
            by_term = by_term[np.argsort(rows.term[by_term], kind="stable")]
            terms, first, counts = np.unique(rows.term[by_term] - dense, return_index=True, return_counts=True)
            to = np.repeat(free[terms] - first, counts) + np.arange(len(by_term))
            examples[to], weights[to] = at[rows.row[by_term]], rows.n[by_term]
            free[terms] += counts
        return cls(labels[order], [keys[i] for i in order.tolist()], order, table,
                   table.reshape(blocks, BLOCK, dense).max(axis=1).T if blocks else np.zeros((dense, 0)),
                   starts, examples, weights)

    def nearest(self, rows: Rows, n: int, k: int, without: Sequence | None = None) -> list[list[tuple[float, int]]]:
        """For each of ``n`` texts the ``k`` examples of largest cosine above 0, ties in the order of keys.

        ``without`` has a key for each text, whose examples do not count.
        """
        found: list[list[tuple[float, int]]] = []
        own: dict = {}
        if without is not None:
            for i, key in enumerate(self.keys):
                own.setdefault(key, []).append(i)
        for first in range(0, n, QUERIES):
            size = min(QUERIES, n - first)
            part = slice(*np.searchsorted(rows.row, [first, first + size]))
            barred = [own.get(key, []) for key in without[first:first + size]] if without is not None else [[]] * size
            found += self._some(rows.row[part] - first, rows.term[part], rows.n[part], size, k, barred)
        return found

    def _some(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, k: int, barred: list) -> list:
        dense, blocks = self.most.shape
        n = blocks * BLOCK
        if not n:
            return [[] for _ in range(size)]
        frequent = term < dense
        query = np.zeros((size, dense))
        query[row[frequent], term[frequent]] = weight[frequent]
        other = term[~frequent] - dense
        sizes = self.starts[other + 1] - self.starts[other]
        part = np.zeros((size, n))
        text, scale = row[~frequent], weight[~frequent]
        before = np.cumsum(sizes) - sizes
        own = before - before[np.searchsorted(text, text)]  # postings of the same text's earlier terms
        cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(own // POSTINGS) != 0)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)]):
            piece = slice(first, last)
            if last > first:
                part[text[first]] += np.bincount(
                    gather(self.examples, self.starts[other[piece]], sizes[piece]), minlength=n,
                    weights=np.repeat(scale[piece], sizes[piece]) * gather(self.weights, self.starts[other[piece]], sizes[piece]))
        bound = query @ self.most + part.reshape(size, blocks, BLOCK).max(axis=2)
        scores = np.full((size, n), -1.0)
        done = np.zeros(bound.shape, bool)

        def evaluate(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                texts = np.flatnonzero(wanted[:, block])
                stretch = slice(block * BLOCK, (block + 1) * BLOCK)
                scores[texts, stretch] = part[texts, stretch] + query[texts] @ self.table[stretch].T
            for text, examples in enumerate(barred):
                scores[text, examples] = -1.0
            done[wanted] = True

        best = np.argsort(-bound, axis=1)[:, :FIRST_BLOCKS]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        evaluate(first & (bound > 0))
        least = np.zeros(size)
        if best.shape[1] * BLOCK >= k:
            held = scores.reshape(size, blocks, BLOCK)[np.arange(size)[:, None], best].reshape(size, -1)
            least = np.maximum(np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k], 0.0)
        evaluate((bound >= least[:, None] - 1e-9) & (bound > 0) & ~done)
        scores = scores[:, :len(self.keys)]
        text, example = np.nonzero((scores >= least[:, None] - 1e-9) & (scores > 0))
        nearness = np.round(scores[text, example], 12)
        order = np.lexsort((self.place[example], -nearness, text))
        text, example, nearness = text[order], example[order], nearness[order]
        starts = np.searchsorted(text, np.arange(size + 1))
        return [list(zip(nearness[a:min(z, a + k)].tolist(), example[a:min(z, a + k)].tolist()))
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist())]


def vote(found: list[tuple[float, int]], labels: np.ndarray) -> float | None:
    """Share of label 1 among the neighbours, weighted by 1 / (distance + 0.1); None without neighbours."""
    if not found:
        return None
    weights = np.array([1 / (1.1 - s) for s, _ in found])
    return float(weights @ labels[[i for _, i in found]] / weights.sum())


def rising(values: np.ndarray, labels: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Calibration that never falls: mean label by bin of the value, neighbours pooled while they fall.

    Equal values (to nine digits) are never parted.
    """
    kinds, of = np.unique(np.round(values, 9), return_inverse=True)
    counts, sums = np.bincount(of, minlength=len(kinds)), np.bincount(of, weights=labels, minlength=len(kinds))
    full = -(-len(values) // max(bins, 1))
    pooled: list[list[float]] = []  # [sum of labels, n, largest value]
    is_open = False
    for value, n, total in zip(kinds.tolist(), counts.tolist(), sums.tolist()):
        if is_open:
            last = pooled.pop()
            total, n = total + last[0], n + last[1]
        pooled.append([total, n, value])
        is_open = n < full
        while not is_open and len(pooled) > 1 and pooled[-2][0] * pooled[-1][1] >= pooled[-1][0] * pooled[-2][1]:
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0] + last[0], pooled[-1][1] + last[1], last[2]]
    while len(pooled) > 1 and pooled[-2][0] * pooled[-1][1] >= pooled[-1][0] * pooled[-2][1]:
        last = pooled.pop()
        pooled[-1] = [pooled[-1][0] + last[0], pooled[-1][1] + last[1], last[2]]
    return np.array([p[2] for p in pooled]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pooled])


@dataclass
class Calibration:
    """Score of a vote; ``bare`` is that of a text without neighbours."""

    edges: np.ndarray
    chances: np.ndarray
    bare: float

    @classmethod
    def of(cls, votes: list[float | None], labels: list[int]) -> Calibration:
        judged = [(v, y) for v, y in zip(votes, labels) if v is not None]
        lone = [y for v, y in zip(votes, labels) if v is None]
        edges, chances = (np.zeros(0), np.zeros(0)) if not judged else rising(
            np.array([v for v, _ in judged]), np.array([y for _, y in judged], float), max(1, len(judged) // BIN_ROWS))
        # Without examples of the kind, as all examples are.
        return cls(edges, chances, (sum(lone) + 0.5) / (len(lone) + 1) if lone else (sum(labels) + 0.5) / (len(labels) + 1))

    def score(self, raw: float | None) -> float:
        if raw is None or not len(self.edges):
            return self.bare
        return float(np.interp(round(raw, 9), self.edges, self.chances))


# --- fitting -----------------------------------------------------------------------


@dataclass
class Model:
    """Terms and examples as they are sent to the workers; the index is built there from the numbers of each term."""

    terms: Terms
    labels: np.ndarray
    keys: list
    sizes: np.ndarray  # terms of each example
    term: np.ndarray
    n: np.ndarray

    @cached_property
    def index(self) -> BlockMaxIndex:
        def parts() -> Iterator[Rows]:
            ends = np.cumsum(self.sizes)
            for first in range(0, len(ends), LOADED):  # some examples at a time, for the sake of memory
                last = min(first + LOADED, len(ends))
                part = slice(int(ends[first] - self.sizes[first]), int(ends[last - 1]))
                row = np.repeat(np.arange(last - first), self.sizes[first:last])
                weight = (1 + np.log(self.n[part])) * self.terms.weights[self.term[part]]
                length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=last - first))
                yield Rows(row + first, self.term[part], weight / length[row])

        found = BlockMaxIndex.build(parts, self.labels, self.keys, len(self.terms.names))
        self.sizes = self.term = self.n = None  # the index has them now
        return found


def example_words(examples: DataFrame) -> pa.Table:
    """(row, label, words, n) of each example with its distinct words, in the order of ``row`` and ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = text_terms(batch.column(2))
            cuts = pa.array(np.searchsorted(rows.row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, words.take(pa.array(rows.term))),
                 pa.ListArray.from_arrays(cuts, pa.array(rows.n.astype(np.int32)))], ["row", "label", "words", "n"])

    kind = examples.schema["row"].dataType.simpleString()
    found = examples.select("row", "label", "text").mapInArrow(
        lean(run), f"row {kind}, label int, words array<string>, n array<int>").toArrow()
    return found.take(pc.sort_indices(found.select(["row", "label"]), sort_keys=[("row", "ascending"), ("label", "ascending")]))


def model_of(listed: pa.Table) -> Model:
    """The model of all examples: terms in falling order of the examples that have them, equal ones by name."""
    labels, lists = listed["label"].to_numpy().astype(np.int64), listed["words"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    df = np.bincount(code, minlength=len(coded.dictionary))
    hits = np.bincount(code, weights=np.repeat(labels, sizes), minlength=len(df))
    order = pc.sort_indices(pa.table({"df": df, "term": coded.dictionary}),
                            sort_keys=[("df", "descending"), ("term", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    terms = Terms.of(coded.dictionary.take(pa.array(order)), df[order], hits[order], len(labels), int(labels.sum()))
    return Model(terms, labels, listed["row"].to_pylist(), sizes, place[code], listed["n"].combine_chunks().flatten().to_numpy())


def fit(labelled: DataFrame, key: str, text: str, label: str) -> tuple[Broadcast, Calibration]:
    """Fit on all rows of ``labelled``, which the caller bounds: their words and votes come to the driver."""
    spark = labelled.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    examples = reliable_checkpoint(labelled.select(
        F.col(key).alias("row"), F.col(label).cast("int").alias("label"), F.col(text).alias("text")), "examples")
    shared = spark.sparkContext.broadcast(model_of(example_words(examples)))
    spare_memory()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.index.nearest(model.terms.vectors(batch.column(2)), batch.num_rows, NEAREST, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([vote(f, model.index.labels) for f in found], pa.float64()), batch.column(1)], ["vote", "label"])

    judged = examples.select("row", "label", "text").mapInArrow(lean(votes), "vote double, label int").toArrow()
    judged = judged.take(pc.sort_indices(judged, sort_keys=[("vote", "ascending"), ("label", "ascending")]))
    return shared, Calibration.of(judged["vote"].to_pylist(), judged["label"].to_pylist())


def score(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          max_examples: int = 12_000, carry: Sequence[str] = ()) -> DataFrame:
    """(key, carry..., score, predicted, evidence, terms) for every row of ``docs``.

    ``labelled`` has (key, text, label 0 or 1); the model is fitted on all its rows or,
    by a hash of the key, on about ``max_examples`` of them; rows with a null label are
    left out and null texts are empty. ``score`` is the calibrated vote of the nearest
    examples, ``predicted`` is 1 from 0.5 on, ``evidence`` lists the keys of the three
    nearest examples, ties in the order of keys, and ``terms`` the terms of the text that
    weigh most. An example finds itself at a cosine of 1. A text that shares no word with
    any example, null and empty texts included, has no neighbours and gets the share of
    label 1 among examples of that kind, or among all if there are none. Repeated rows are
    judged one by one; without labelled rows every score is 0.5; empty tables give empty
    tables; columns outside ``carry`` are not read.
    """
    known = labelled.where(F.col(label).isNotNull())
    n = known.select(key).count()
    if n > max_examples:
        known = known.where(hash32(F.col(key), seed=7) < F.lit(int(2 ** 32 * max_examples / n)))
    shared, calibration = fit(known, key, text, label)
    kind = docs.schema[key].dataType
    made = {"score": "double", "predicted": "int", "evidence": f"array<{kind.simpleString()}>", "terms": "array<string>"}

    def start():
        terms, index = shared.value.terms, shared.value.index

        def judge(batch: pa.RecordBatch) -> list:
            pa.default_memory_pool().release_unused()  # of the batch before
            rows = terms.vectors(batch.column(0))
            found = index.nearest(rows, batch.num_rows, NEAREST)
            scores = np.array([calibration.score(vote(f, index.labels)) for f in found], float)
            strongest = np.lexsort((rows.term, -rows.n, rows.row))
            place = np.arange(len(strongest)) - np.searchsorted(rows.row, rows.row)
            strongest = strongest[place < SHOWN]
            cuts = np.searchsorted(rows.row[strongest], np.arange(batch.num_rows + 1)).astype(np.int32)
            shown = terms.names.take(pa.array(rows.term[strongest])) if len(terms.names) else pa.array([], pa.string())
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                    pa.array([[index.keys[i] for _, i in f[:3]] for f in found], pa.list_(batch.column(1).type)),
                    pa.ListArray.from_arrays(cuts, shown.cast(pa.string()))]

        return judge

    return pass_on(with_carried(docs, key, text, carry), start, made, key, text, carry)
