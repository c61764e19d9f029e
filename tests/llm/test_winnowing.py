import hashlib

import numpy as np
import pytest
from helpers import documents, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evenhand.llm.queries import QUERIES
from evenhand.llm.registry import table
from evenhand.llm.winnowing import BASE, beside_next, fingerprint_all, fingerprints, likeness, range_of, rightmost_least


def mixed(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2 ** 64
    return (h ^ h >> 32) >> 1


def plain(text, gram, window):
    """(hash, position) of the rightmost smallest hash of every window."""
    codes = [ord(c) + 1 for c in text]
    codes += [0] * (gram - len(codes)) if codes else []
    hashes = [mixed(sum(c * pow(BASE, gram - 1 - j, 2 ** 64) for j, c in enumerate(codes[i:i + gram])) % 2 ** 64)
              for i in range(len(codes) - gram + 1)]
    found = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[i:i + window]
        at = max(j for j, h in enumerate(part) if h == min(part))
        found.add((i + at, part[at]))
    return [(h, p) for p, h in sorted(found)]


def pairs(found):
    return [list(zip(h.tolist(), p.tolist())) for h, p in found]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("abé \U0001F600", max_size=60), max_size=6), st.integers(1, 9), st.integers(1, 9), st.integers(1, 40))
def test_choice_equals_plain_windows(texts, gram, window, block):
    want = [plain(t, gram, window) for t in texts]
    assert pairs(fingerprint_all(texts, gram, window)) == want
    assert pairs(fingerprint_all(texts, gram, window, block)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 40))
def test_rightmost_least(values, window):
    window = min(window, len(values))
    got = rightmost_least(np.array(values, np.uint64), window)
    assert got.tolist() == [i + max(j for j in range(window) if values[i + j] == min(values[i:i + window]))
                            for i in range(len(values) - window + 1)]


def test_shared_passages_share_a_hash():
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for _ in range(200):
        passage = noise(32 + 16 - 1)
        (a, _), (b, _) = fingerprint_all([noise(int(rng.integers(0, 90))) + passage + noise(3), noise(7) + passage + noise(int(rng.integers(0, 90)))])
        assert len(np.intersect1d(a, b))
    assert likeness(np.zeros(0), np.zeros(0)) == 1.0 and likeness(np.array([1]), np.zeros(0)) == 0.0


def test_operator_on_awkward_documents(spark, no_docs):
    got = fingerprints(documents(spark)).collect()
    want = [(i, len(t or ""), pairs(fingerprint_all([t or ""]))[0]) for i, t, *_ in rows()]
    assert sorted(((r.doc_id, r.n_chars, [tuple(x) for x in r.prints]) for r in got), key=str) == sorted(want, key=str)
    assert fingerprints(no_docs).collect() == [] and beside_next(no_docs).collect() == []


def plain_beside(content, gram=16, window=32):
    order = lambda k: (k is not None, k)
    keys = sorted({r[0] for r in content}, key=order)
    head = {k: min((r[1] or "" for r in content if r[0] == k)) for k in keys}
    found = []
    for key, text, *_ in content:
        text, nxt = text or "", head[keys[(keys.index(key) + 1) % len(keys)]]
        q = len(text) // 4
        edited = text[:len(text) - q] + nxt[:q]
        (a, _), (b, _), (c, _) = fingerprint_all([text, edited, nxt], gram, window)
        found.append((key, len(text), edited, a.tolist(), b.tolist(), likeness(a, b), likeness(a, c)))
    return sorted(found, key=str)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_next_document_across_ranges(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = beside_next(documents(spark).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == plain_beside(rows())


@pytest.mark.parametrize("content", [
    [(5, "only one document of some length " * 3, None, None, 0)],
    [(None, "a text without a key " * 4, None, None, 0), (None, "another one " * 9, None, None, 0)],
    [(1, "small " * 20, None, None, 0), (1, "same key and larger " * 20, None, None, 0), (2, "second " * 30, None, None, 0)],
])
def test_few_keys(spark, content):
    got = beside_next(documents(spark, content)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_beside(content)


def test_text_keys(spark):
    content = [(chr(97 + i % 9) * (1 + i % 4), f"text number {i} " * (i + 1)) for i in range(30)]
    got = beside_next(spark.createDataFrame(content, "doc_id string, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_beside(content)


def test_range_of(spark):
    cuts = [2, 5, 9]
    rows_ = spark.range(0, 12).select("id", range_of(F.col("id"), cuts, "bigint").alias("r")).collect()
    assert [r.r for r in sorted(rows_)] == [sum(c <= i for c in cuts) for i in range(12)]


def test_query_equals_plain_search(spark, sf_dir):
    content = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    digits = lambda hashes: "".join(f"{h >> 31:08x}" for h in hashes)
    want = [(k, n, hashlib.sha256(e.encode()).hexdigest(), digits(a), digits(b), x, y) for k, n, e, a, b, x, y in plain_beside(content)]
    got = QUERIES["op12_winnowing"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    known = {r[1]: g.fingerprint for r in content for g in got if g.doc_id == r[0]}
    assert all(known[r[1]] == g.fingerprint for r in content for g in got if g.doc_id == r[0])
    assert sum(g.near_edited > g.near_next for g in got) > 0.9 * len(got)
