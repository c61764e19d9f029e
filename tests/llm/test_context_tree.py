import math
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from helpers import documents, rows
from pyspark.sql import functions as F

from evenhand.llm.context_tree import DEPTH, score


def tokens(text):
    return (text or "").encode().lower().split()


def stream(text):
    return b"\xff" * DEPTH + b" ".join(tokens(text)) + b"\xff"


class Tree:
    """Context-tree weighting by plain recursion; contexts are read from the last byte back."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for text in texts:
            data = stream(text)
            for i in range(DEPTH, len(data)):
                for j in range(8):
                    node = (1 << j) | (data[i] >> (8 - j))
                    for d in range(DEPTH + 1):
                        context = data[i - d:i]
                        self.n[node, context][data[i] >> (7 - j) & 1] += 1
                        if d:
                            self.below[node, context[1:]].add(context)

    def estimate(self, node, context):
        a, b = self.n[node, context]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)  # noqa: B019
    def weighted(self, node, context):
        if len(context) == DEPTH:
            return self.estimate(node, context)
        x, y = self.estimate(node, context), self.children(node, context)
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    def children(self, node, context):
        return sum(self.weighted(node, c) for c in self.below[node, context])

    def one(self, node, data, i, d=0):
        context = data[i - d:i]
        a, b = self.n[node, context]
        own = (b + 0.5) / (a + b + 1)
        if d == DEPTH or (node, data[i - d - 1:i]) not in self.n:
            return own
        share = 1 / (1 + math.exp(min(700, self.children(node, context) - self.estimate(node, context))))
        return share * own + (1 - share) * self.one(node, data, i, d + 1)

    def log10(self, text):
        data, total = stream(text), 0.0
        for i in range(DEPTH, len(data)):
            for j in range(8):
                node = (1 << j) | (data[i] >> (8 - j))
                p = self.one(node, data, i) if (node, b"") in self.n else 0.5
                total += math.log10(p if data[i] >> (7 - j) & 1 else 1 - p)
        return total


def base(texts, text):
    counts = Counter(t for x in texts for t in [*tokens(x), None])
    whole = sum(counts.values()) + 0.1 * (len(counts) + 1)
    return sum(math.log10((counts[t] + 0.1) / whole) for t in [*tokens(text), None]), sum(counts[t] > 0 for t in [*tokens(text), None])


def test_equals_plain_recursion(spark):
    content = [(i, f"the sea {'and' * (i % 3)} Sea of thing{i % 4}\nxyz", "en", "s", 0) for i in range(12)]
    content += [(50, None, None, None, None), (51, "", None, None, None), (52, "été q", None, None, None), (None, "the end", None, None, None)]
    docs = documents(spark, content)
    got = score(docs, F.col("doc_id") % 4 == 0, word_share=8).collect()
    training = [t for i, t, *_ in content if i is not None and i % 4]
    tree = Tree(training)
    texts = {i: t for i, t, *_ in content}
    assert len(got) == len(content)
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == (r.doc_id is None or r.doc_id % 4 == 0)
        assert r.n_tokens == len(tokens(text)) + 1 and r.train_tokens == sum(len(tokens(t)) + 1 for t in training)
        want, known = base(training, text)
        assert r.base_score == pytest.approx(want, abs=1e-9) and r.n_known == known
        assert r.score == pytest.approx(tree.log10(text), abs=1e-4)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(stream(text)) - DEPTH))


@pytest.mark.parametrize("sent", [0, 8, 1 << 20])
def test_nodes_that_are_not_broadcast_count_in_full(spark, sent):
    content = [(i, f"the sea {'and' * (i % 3)} Sea of thing{i % 4} name{i}\nxyz", "en", "s", 0) for i in range(12)]
    docs = documents(spark, content + [(52, "été thing2 name3 q", None, None, None)])
    got = score(docs, F.col("doc_id") % 4 == 0, sent_strings=sent, word_share=8).collect()
    tree = Tree([t for i, t, *_ in content if i % 4])
    texts = {i: t for i, t, *_ in content} | {52: "été thing2 name3 q"}
    assert len(got) == 13
    for r in got:
        assert r.score == pytest.approx(tree.log10(texts[r.doc_id]), abs=1e-4)


def test_awkward_rows_and_pruned_nodes(spark, docs):
    got = score(docs, F.col("doc_id") % 10 == 0, sent_strings=64, word_share=4).collect()
    assert len(got) == len(rows()) and all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    training = [t for i, t, *_ in rows() if i is not None and i % 10]
    for r in got:
        if r.doc_id in (1, 10, 200, 201, 205, 206):
            text = next(t for i, t, *_ in rows() if i == r.doc_id)
            assert (r.base_score, r.n_known) == pytest.approx(base(training, text))


def test_probabilities_of_all_next_bytes_sum_to_one(spark):
    from evenhand.llm.context_tree import Coder, lower_levels, string_counts, top_of
    import numpy as np

    texts = spark.createDataFrame([("the sea and the thing of the sea " * 5,)] * 3, "text string")
    counts = string_counts(texts)
    rows = counts.toArrow().sort_by("string")
    coder = Coder(top_of(counts, counts.count()), lower_levels(rows["string"].to_numpy(), rows["n"].to_numpy())[0])
    for context in (b"e sea", b"\xff\xff\xff\xff\xff", b"qqqqq"):
        start = sum(b << (8 * (DEPTH - 1 - i)) for i, b in enumerate(context)) << 8
        assert (2 ** coder.logs_of(np.arange(start, start + 256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_nothing_to_learn_from(spark, docs, no_docs):
    got = score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.bits_per_byte == pytest.approx(8) for r in got)
    assert all(r.base_score == pytest.approx(r.n_tokens * math.log10(0.1 / 0.1)) for r in got)
    assert score(no_docs, F.lit(False)).count() == 0
