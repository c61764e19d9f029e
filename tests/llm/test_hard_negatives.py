import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import hard_negatives as module
from evenhand.llm.hard_negatives import Asked, best_hits, bounds, hard_negatives, opened, packed, products, search, share, unpacked
from evenhand.llm.hilbert import cells, hilbert_keys
from evenhand.llm.queries import QUERIES
from evenhand.llm.registry import table


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (5, 1), (3, 3), (1, 4)])
def test_curve_visits_all_cells_by_single_steps(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint8)
    keys = hilbert_keys(grid, bits)
    along = grid[sorted(range(len(grid)), key=keys.__getitem__)].astype(int)
    assert len(set(keys)) == len(grid) and (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()
    assert cells(np.array([[-1.0, 0.0, 1.0]]), -1.0, 1.0, 2).tolist() == [[0, 2, 3]]


def test_products_are_exact_at_every_size():
    rng = np.random.default_rng(1)
    for size in (2 ** 7, 2 ** 20, 2 ** 40, 2 ** 62):
        a, b = rng.integers(-size, size, (5, 3)), rng.integers(-size, size, (4, 3))
        want = [[max(-2 ** 63, min(2 ** 63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert products(a, b).tolist() == want
        assert (unpacked(packed(a), 5, 3) == a).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, anchors = rng.integers(-99, 99, (50, 6)), rng.integers(-99, 99, (20, 6))
    low, high = bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (scores >= low).all() and (scores <= high).all()


def test_far_blocks_are_not_read(monkeypatch):
    """Blocks apart in space: an anchor's window needs its own block only."""
    rng = np.random.default_rng(3)
    blocks = []
    for side in range(8):
        vectors = rng.integers(0, 5, (40, 8))
        vectors[:, side] += 200
        blocks.append(opened({"dim": 8, "numbers": np.arange(side * 40, side * 40 + 40).astype("<i8").tobytes(),
                              "labels": ["a", "b"] * 20, "vectors": packed(vectors),
                              "lows": vectors.min(axis=0).astype("<i8").tobytes(), "highs": vectors.max(axis=0).astype("<i8").tobytes()}))
    read = []
    monkeypatch.setattr(module, "products", lambda a, b: read.append(len(b)) or products(a, b))
    anchor = np.zeros((1, 8), np.int64)
    anchor[0, 3] = 200
    row, _, score, number = search(Asked(np.array([-1]), ["a"], anchor, np.array([[30_000]]), np.array([[2 ** 62]])), blocks, True, 5)
    assert len(read) == 1 and len(row) == 5 and set(number.tolist()) <= set(range(120, 160)) and (np.diff(score) <= 0).all()


def test_best_hits():
    hits = [(np.array([0, 0, 1]), np.array([0, 0, 0]), np.array([5, 7, 1]), np.array([3, 9, 9])),
            (np.array([0, 0]), np.array([0, 1]), np.array([7, 2]), np.array([4, 1]))]
    assert [x.tolist() for x in best_hits(hits, 2)] == [[0, 0, 0, 1], [0, 0, 1, 0], [7, 7, 2, 1], [4, 9, 1, 9]]


def test_shares(spark):
    scores = [-251, -250, -1, 0, 1, 5, 99, 100, 101, 2 ** 62]
    got = spark.createDataFrame([(s,) for s in scores], "s long").select(
        "s", share(F.col("s"), 80, True).alias("a"), share(F.col("s"), 100, False).alias("b"), share(F.col("s"), 33, False).alias("c")).collect()
    assert [(r.s, r.a, r.b, r.c) for r in got] == [(s, -(-80 * s // 100), s, 33 * s // 100) for s in scores]


def plain(rows, is_anchor, positives=5, negatives=5, least=80, most=100):
    rows = [(k, str(label), v) for k, label, v in rows if k is not None and label is not None and v and None not in v]
    found = []
    asked = {}
    for k, label, v in rows:
        if is_anchor(k):
            width = 2 if max(map(abs, v)) < 2 ** 15 else 8
            asked[k] = min(asked.get(k, (label, b"\xff" * 99, v)), (label, np.array(v, f"<i{width}").tobytes(), v))
    for k, (label, _, v) in asked.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != k and len(w) == len(v))
        for s, j, _ in [x for x in near if x[2] == label][:positives]:
            hard = [x for x in near if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            found += [(k, j, r, x[1], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(found)


@pytest.mark.parametrize("seed,labels,dims", [(0, 2, 3), (1, 4, 8), (2, 1, 4)])
def test_equals_plain_search(spark, seed, labels, dims, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, labels)), rng.integers(-6, 7, dims).tolist()) for i in range(700)]
    hot = [(1000 + i, i % 2, [3] * dims) for i in range(350)]  # a third of the rows are one vector
    odd = [(2000, None, [1] * dims), (None, 0, [1] * dims), (2010, 0, None), (2020, 0, [1, None] + [1] * (dims - 2)), (2030, 0, []),
           (2040, 0, [1] * (dims + 1)), (2041, 1, [1] * (dims + 1)), (2042, 0, [2] * (dims + 1)), (2050, 0, [0] * dims),
           (20, 0, [1] * dims), (21, 0, [5] * dims), (21, 0, [5] * dims)]
    content = rows + hot + odd
    given = spark.createDataFrame(content, "vec_id long, label int, vector array<long>").withColumns(
        {c: F.lit("own") for c in ("number", "shard", "low", "rank", "asked", "kind")}).repartition(7)
    got = hard_negatives(given, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain(content, lambda k: k % 10 == 0)


def test_empty_table_and_no_anchors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(1, 0, [1, 2])], empty.schema)
    assert hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []


def test_query_equals_plain_search(spark, sf_dir):
    rows = []
    for r in table(spark, sf_dir, "embeddings").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    got = QUERIES["op13_hard_negatives"](spark, sf_dir).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == plain(
        rows, lambda k: k % 100 == 0)
