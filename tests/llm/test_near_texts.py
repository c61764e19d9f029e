import random

import numpy as np
import pytest
from helpers import SCHEMA, documents
from test_near_copies import united

import corpus_pipeline
from evenhand.llm import near_texts
from evenhand.llm.near_texts import RADIUS, copy_classes, print_keys, shingle_set, similar_pairs
from evenhand.llm.simhash import majority


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10 ** 9)}"
    return words


@pytest.fixture(scope="module")
def texts():
    """Copies with 0 to 12 of 300 words changed, a large group of them, short texts and unrelated ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2_000)]
    found = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=300)
        found += [changed(rng, base, n) for n in (0, 1, 2, 4, 6, 12)]
    hot = rng.choices(vocabulary, k=200)
    found += [changed(rng, hot, rng.randrange(5)) for _ in range(120)] + [rng.choices(vocabulary, k=100) for _ in range(100)]
    return [" ".join(w) for w in found] + ["a b", "A  b", "a b c", "", None]


def least_of(texts):
    """Smallest position of each position's component, by comparing all pairs."""
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or alike(sets[i], sets[j])]
    return united(range(len(sets)), links)


@pytest.mark.parametrize("chunk", [512, 16])
def test_classes_equal_brute_force(spark, monkeypatch, texts, chunk):
    monkeypatch.setattr(near_texts, "CHUNK", chunk)
    got = copy_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in got.collect()} == least_of(texts)


def test_stage_drops_copies_with_a_few_changed_words(spark, sf_dir, texts):
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == set(least_of(texts).values())


def test_rows_without_key_keep_one(spark, sf_dir):
    table = documents(spark, [(None, "a b c d", None, None, None)] * 3 + [(None, "e f", None, None, None), (7, "E f", None, None, None)])
    kept = corpus_pipeline.drop_near_copies(spark, table, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "E f"), ("None", "a b c d")]


def test_empty_table(spark, sf_dir, no_docs):
    assert corpus_pipeline.drop_near_copies(spark, no_docs, sf_dir).count() == 0


def test_pairs_at_the_threshold_count(monkeypatch):
    monkeypatch.setattr(near_texts, "COLUMNS", 3)
    sets = [np.arange(n, dtype=np.uint64) for n in (8, 10, 11)] + [shingle_set("")]
    assert [tuple(map(int, p)) for p in zip(*similar_pairs(sets, 0.8))] == [(0, 1), (1, 2)]


def test_fingerprints_within_the_radius_are_candidates_without_bands(spark):
    """SimHash alone, no band of minimum hashes: what its links join is compared and dropped, other texts stay."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2_000)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=800)
        texts += [" ".join(changed(rng, base, n)) for n in (0, 1, 2, 40)]
    prints = [majority(shingle_set(t)) for t in texts]
    sets = [plain_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= RADIUS]
    assert len(pairs) >= 12 and all(alike(sets[i], sets[j]) for i, j in pairs)
    want = united(range(len(texts)), pairs)
    got = copy_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), bands=0)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_keys_of_fingerprints_join_what_the_radius_joins(spark):
    rng = random.Random(12)
    prints = []
    for _ in range(30):
        start = rng.getrandbits(63)
        prints += [start, start ^ 0b111, start ^ 0b111 ^ (1 << 40), start ^ (0xFF << 50)]
    classes = spark.createDataFrame([(i, 5, p) for i, p in enumerate(prints)] + [(-1, 0, 0)], "bits long, size long, simhash long")
    keys = {r.bits: r.part for r in print_keys(classes).collect()}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= RADIUS]
    root = united(range(len(prints)), near)
    assert -1 not in keys and len(set(keys.values())) == len(set(root.values()))
    assert all(keys[i] == keys[r] for i, r in root.items())
