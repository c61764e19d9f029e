import hashlib
import zlib

import numpy as np
import pytest
from helpers import documents, rows
from hypothesis import given, settings, strategies as st

from evenhand.llm import periods
from evenhand.llm.periods import Tile, periodic_runs, stretches, tiles
from evenhand.llm.queries import QUERIES
from evenhand.llm.registry import table


def plain_runs(words):
    """All runs by comparing every pair of words."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def stitched(found):
    """Runs of one document from (period, begin, end), as the queries stitch them."""
    runs = {}
    for p in sorted({p for p, _, _ in found}):
        parts = []
        for a, z in sorted((a, z) for q, a, z in found if q == p):
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], z)
            else:
                parts.append([a, z])
        for a, z in parts:
            if z - a + p >= max(24, 3 * p):
                runs.setdefault((a, z - a + p), p)
    return sorted((s, n, p) for (s, n), p in runs.items())


def solved(documents_codes):
    by_class, found = {}, [[] for _ in documents_codes]
    for i, codes in enumerate(documents_codes):
        for tile in tiles(np.array(codes, np.int64)):
            by_class.setdefault(tile.low, []).append((i, tile))
    for group in by_class.values():
        for t, p, a, z in stretches([tile for _, tile in group]):
            found[group[t][0]].append((p, a, z))
    return [stitched(f) for f in found]


def random_document(rng, n):
    """Words of a small vocabulary with repeated stretches of all lengths put in."""
    codes = rng.integers(0, rng.choice([2, 3, 50, 5000]), n)
    for _ in range(rng.integers(0, 5)):
        p = int(np.exp(rng.uniform(0, np.log(max(2, n // 3)))))
        at = int(rng.integers(0, max(1, n - p)))
        size = int(min(n - at, p * rng.uniform(1.5, 8)))
        codes[at:at + size] = np.resize(codes[at:at + p].copy(), size)
    return codes.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_tiles_find_all_runs(seed, monkeypatch):
    """Small tiles, so that documents have many and several classes of them."""
    monkeypatch.setattr(periods, "CORE", 128)
    monkeypatch.setattr(periods, "REACH", 32)
    rng = np.random.default_rng(seed)
    texts = [random_document(rng, int(rng.integers(0, 1500))) for _ in range(40)]
    assert solved(texts) == [plain_runs(t) for t in texts]


def test_whole_tiles_find_all_runs():
    rng = np.random.default_rng(9)
    texts = [random_document(rng, int(rng.integers(0, 900))) for _ in range(60)]
    assert solved(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(1, 30), st.integers(0, 200))
def test_binary_texts(start, period, more):
    codes = start + [(start or [0])[-min(period, len(start) or 1):][i % min(period, len(start) or 1)] for i in range(more)]
    assert solved([codes]) == [plain_runs(codes)]


def test_long_uniform_and_doubled_texts(monkeypatch):
    monkeypatch.setattr(periods, "CORE", 256)
    monkeypatch.setattr(periods, "REACH", 64)
    uniform = [0] * 3000
    thue = [bin(i).count("1") % 2 for i in range(2048)]  # no stretch has a power above 2
    apart = [0] * 400 + [1] + [0] * 400 + [1] + [0] * 400 + [1]
    assert solved([uniform, thue, apart]) == [[(0, 3000, 1)], [], plain_runs(apart)]
    assert Tile(np.zeros(0), 0, 0, 1, 2).whole == 0


def test_operator_on_awkward_documents(spark):
    repeated = [(900 + i, " ".join(f"w{j % (3 + 5 * i)}" for j in range(90)) + " end of it", "en", "s", 1) for i in range(4)]
    content = rows() + repeated + repeated[:1] + [(900, "other text of the same key", "en", "s", 1)]
    got = periodic_runs(documents(spark, content)).collect()
    want = []
    for key, text, *_ in content:
        words = plain_words(text)
        runs = [(0, 240_000, 8)] if len(words) == 240_000 else plain_runs(words)
        kept = " ".join(words[:8]) if len(words) == 240_000 else plain_collapsed(words, runs)
        want.append((key, len(words), runs, kept))
    as_rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(as_rows, key=str) == sorted(want, key=str)


def test_empty_table(spark, no_docs):
    assert periodic_runs(no_docs).collect() == []


def fast_runs(words):
    """As plain_runs, the comparisons of one period at once."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([code[w] for w in words], np.int64), {}
    for p in range(1, len(x) // 3 + 1):
        change = np.diff(np.concatenate([[0], (x[:-p] == x[p:]).astype(np.int8), [0]]))
        for a, z in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
            if z - a + p >= max(24, 3 * p):
                found.setdefault((a, z - a + p), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def test_query_equals_plain_search(spark, sf_dir):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for r in table(spark, sf_dir, "documents").collect():
        words = plain_words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = fast_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        want.append((r.doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                     digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(plain_collapsed(words, runs))))
    got = QUERIES["op11_periods"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs for r in got) > 10
