import random
import re

import numpy as np
import pytest
import xxhash
from helpers import documents, rows
from hypothesis import given, settings, strategies as st

from evenhand.llm import simhash
from evenhand.llm.components import components
from evenhand.llm.simhash import fingerprint, keep_first, near_classes, near_links, near_pairs, roots_of


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abAB \t\n Éx", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_find_the_pairs_within_the_radius(radius):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for s in seeds for _ in range(15)]
    values = np.array(sorted(set(values)), np.uint64)
    found = {(int(i), int(j)) for a, b in near_pairs(values, np.full(len(values), len(values)), radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if int(values[i] ^ values[j]).bit_count() <= radius}
    assert found == want


def test_buckets_of_any_size_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    hot = {base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}
    far = {rng.getrandbits(64) for _ in range(300)}
    chain, v = set(), rng.getrandbits(64)
    for i in range(40):
        v ^= 3 << i
        chain.add(v)
    values = sorted(x - (1 << 64) if x >> 63 else x for x in hot | far | chain)
    links = near_links(spark.createDataFrame([(v,) for v in values], "bits long")).collect()
    near = [(a, b) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2]
    assert united(values, [(r.a, r.b) for r in links]) == united(values, near)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300), (5, 4), (5, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = united({n for link in links for n in link}, links)
    assert got == {n: r for n, r in want.items() if n != 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_kept_rows(spark, docs):
    prints = [(i, format(plain_fingerprint(t), "016x")) for i, t, *_ in rows()]
    got = near_classes(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(prints, key=str)
    kinds = sorted({f for _, f in prints})
    near = [(a, b) for a in kinds for b in kinds if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 2]
    root = united(kinds, near)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[r.fingerprint]) for r in got)
    kept = keep_first(docs, near_classes(docs)).collect()
    assert len(kept) == len(set(root.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())
    assert all(r["size"] == "own size" for r in kept)


def test_rows_without_key_keep_one(spark):
    table = documents(spark, [(None, "a b c d", None, None, None)] * 3 + [(None, "e f g h", None, None, None), (7, "e f g h", None, None, None)])
    kept = keep_first(table, near_classes(table)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "e f g h"), ("None", "a b c d")]


def test_empty_table(no_docs):
    assert near_classes(no_docs).count() == 0
    assert keep_first(no_docs, near_classes(no_docs)).count() == 0


def test_roots_of_blocks():
    assert roots_of(6, iter([(np.array([5, 1]), np.array([3, 2])), (np.array([3]), np.array([1]))])).tolist() == [0, 1, 1, 1, 4, 1]
