"""What a Python worker holds, so that stages that share workers stay within an executor's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from evenhand.llm import bpe, toxicity
from evenhand.llm.registry import tokenizer_file
from evenhand.llm.texts import KEEPERS, lean
from evenhand.llm.toxicity import BlockMaxIndex, Rows, Terms


def test_looking_up_a_few_words_does_not_hash_all_terms():
    names = pa.array([f"term{i}" for i in range(300_000)])
    terms = Terms(names, np.ones(len(names)), 1.0)
    words = pa.array(["term299999", "nothing", "term0", "term131072", "Term1"])
    usual = pa.default_memory_pool()
    counted = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(counted)
    try:
        terms.vectors(pa.array(["the sea and the thing"]))
        found = counted.max_memory()
    finally:
        pa.set_memory_pool(usual)
    assert found < 4 << 20
    assert terms.numbers(words).tolist() == [299_999, -1, 0, 131_072, -1]
    assert terms.numbers(words[:0]).tolist() == [] and Terms(names[:0], np.ones(0), 1.0).numbers(words).tolist() == [-1] * 5


def test_index_is_built_without_a_second_copy():
    rng = np.random.default_rng(4)
    n, n_terms, each = 6_000, 60_000, 200
    term = np.sort(rng.integers(0, n_terms, (n, each)), axis=1)

    def parts():
        for first in range(0, n, 500):
            some = np.unique(np.repeat(np.arange(first, first + 500), each) * n_terms + term[first:first + 500].ravel())
            row, of = np.divmod(some, n_terms)
            yield Rows(row, of, 1.0 + of % 7 + row % 3)

    tracemalloc.start()
    index = BlockMaxIndex.build(parts, np.arange(n) % 2, range(n), n_terms, 100)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    held = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray))
    assert peak < 1.8 * held
    postings = {(t + 100, int(index.place[e]), w) for t in range(0, n_terms - 100, 501) for e, w in zip(
        index.examples[index.starts[t]:index.starts[t + 1]].tolist(), index.weights[index.starts[t]:index.starts[t + 1]].tolist())}
    rows = [(t, r, w) for p in parts() for r, t, w in zip(p.row.tolist(), p.term.tolist(), p.n.tolist())]
    assert postings == {x for x in rows if x[0] >= 100 and (x[0] - 100) % 501 == 0}
    assert index.starts[-1] == sum(t >= 100 for t, _, _ in rows)


def test_long_texts_add_up_postings_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(5)
    pair = np.unique(rng.integers(0, 400, 9_000) * 90 + rng.integers(0, 90, 9_000))
    rows = Rows(*np.divmod(pair, 90), rng.random(len(pair)))
    index = BlockMaxIndex.build(lambda: iter([rows]), np.arange(400) % 2, list(range(400)), 90, 10)
    found = index.nearest(rows, 400, 15)
    monkeypatch.setattr(toxicity, "POSTINGS", 300)
    assert index.nearest(rows, 400, 15) == found and all(found)


def test_tasks_of_other_operators_drop_what_a_worker_keeps():
    assert "bpe" in KEEPERS
    first = bpe.vocabulary(tokenizer_file())
    assert list(lean(iter, "bpe")(iter([1, 2]))) == [1, 2] and bpe.vocabulary(tokenizer_file()) is first
    assert list(lean(iter)(iter([1, 2]))) == [1, 2] and bpe.vocabulary.cache_info().currsize == 0


def test_texts_are_encoded_in_small_batches(docs, spark):
    bpe.encode(docs, tokenizer_file())  # counts the words in larger batches first
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(bpe.BATCH_BYTES) == str(1 << 20)
