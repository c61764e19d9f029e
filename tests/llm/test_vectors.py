import numpy as np
import pytest
from test_near_copies import united

from evenhand.llm import hnsw
from evenhand.llm.near_vectors import close_points, near_vectors, unit_rows
from evenhand.llm.neighbours import best_points, lifted, nearest
from evenhand.llm.vectors import Shard

TABLE = "vec_id long, embedding array<float>, label int, n_links long, score double, number long"
NAN, INF = float("nan"), float("inf")


def table(spark, content):
    return spark.createDataFrame([(i, v, 0, -1, -1.0, -1) for i, v in content], TABLE)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def content():
    rng = np.random.default_rng(4)
    found = [(i, rng.normal(size=8)) for i in range(300)]
    centre = rng.normal(size=8)
    found += [(1000 + i, centre + 0.05 * rng.normal(size=8)) for i in range(200)]  # a large group of near copies
    found += [(2000 + i, centre * 2) for i in range(60)]  # and of equal vectors
    found = [(i, [float(np.float32(x)) for x in v]) for i, v in found]
    found += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [NAN] * 8), (3004, [INF] + [1.0] * 7), (3005, [None] + [1.0] * 7),
              (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, found[0][1]), found[5], found[5]]
    return found


def test_graph_recall_grows_with_the_beam():
    points = np.random.default_rng(0).normal(size=(3000, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    graph, order = hnsw.build(points)
    assert sorted(order.tolist()) == list(range(3000)) and len(graph.layers) > 1
    queries = points[:200]
    exact = np.argsort(-queries @ points.T, axis=1)[:, :10]
    recall = []
    for beam in (16, 64, 256):
        _, found = hnsw.search(graph, queries, beam)
        recall.append(np.mean([len(set(order[f]) & set(e.tolist())) / 10 for f, e in zip(found, exact)]))
    assert recall == sorted(recall) and recall[-1] > 0.99


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_small_graphs_are_whole(n):
    points = np.random.default_rng(n).normal(size=(n, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    graph, _ = hnsw.build(points)
    sims, found = hnsw.search(graph, np.eye(4), max(n, 1))
    assert (np.sort(found, axis=1)[:, :n] == np.arange(n)).all() if n else (found == -1).all()


def test_links_and_components(spark, content):
    got = near_vectors(table(spark, content)).collect()
    assert len(got) == len(content)
    good = [(i, np.array(v, float) / np.linalg.norm(v), len(v)) for i, v in content if usable(v) and i is not None]
    links = {i: 0 for i, _ in content}
    pairs = []
    for a, (i, v, d) in enumerate(good):
        for j, w, e in good[a + 1:]:
            if d == e and v @ w >= 0.9:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    links[5] = links[5] // 3  # three rows of one id and vector: each links with the two others
    root = united({i for i, _ in content if i is not None}, [p for p in pairs if p[0] != p[1]])
    for r in got:
        assert r.component_id == (None if r.vec_id is None else root[r.vec_id])
        assert r.kept == (r.vec_id is not None and root[r.vec_id] == r.vec_id)
        if r.vec_id != 5:
            assert r.n_links == links[r.vec_id]


def test_nearest_by_inner_product(spark, content):
    whole = table(spark, content)
    queries = table(spark, [c for c in content if c[0] is not None and c[0] % 20 == 0])
    got = {}
    for r in nearest(whole, queries, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v in content if usable(v) and i is not None]
    hits = total = 0
    for i, v in good:
        if i % 20:
            continue
        want = sorted((-float(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:20]
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        hits += sum(s >= -want[-1][0] - 1e-9 for *_, s in found)
        total += len(want)
    assert hits / total > 0.97 and set(got) == {i for i, _ in good if i % 20 == 0}


def test_ties_go_to_the_smaller_key(spark):
    whole = table(spark, [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0])])
    got = nearest(whole, whole.where("vec_id = 3"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5] and {r.score for r in got} == {1.0}


def test_empty_tables(spark, content):
    empty = table(spark, [])
    assert near_vectors(empty).count() == 0
    assert nearest(empty, empty).count() == 0
    assert nearest(table(spark, content), empty).count() == 0


def one_shard(points, unit):
    """A shard with its graph, as a task reads it back; numbers are positions."""
    made, order = hnsw.build(unit(points), seed=1)
    return Shard({
        "numbers": order.astype("<i8").tobytes(), "counts": np.ones(len(points), "<i8").tobytes(), "dim": points.shape[1],
        "vectors": points[order].astype("<f8").tobytes(), "sizes": [len(x) for x in made.layers],
        "links": b"".join(x.astype("<i4").tobytes() for x in made.layers)}, unit)


def beside(rng, base, least, most):
    """Vectors at a cosine between the bounds to the rows of ``base``."""
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(least, most, (len(base), 1))
    return cosine * base + np.sqrt(1 - cosine ** 2) * other


@pytest.mark.parametrize("hot", [0, 2_500])
def test_small_pairs_are_found_in_a_shard_of_thousands(hot):
    """Pairs just above the threshold beside unrelated points and a large group, on the path that walks the graph."""
    rng = np.random.default_rng(6)
    alone = unit_rows(rng.normal(size=(6_000, 64)))
    group = beside(rng, np.repeat(unit_rows(rng.normal(size=(1, 64))), hot, axis=0), 0.96, 0.999) if hot else np.zeros((0, 64))
    points = np.concatenate([alone, beside(rng, alone[:1_500], 0.9, 0.99), group])
    shard = one_shard(points, unit_rows)
    order = shard.numbers
    small = np.concatenate([np.arange(1_500), np.arange(6_000, 7_500)])
    rows = np.sort(rng.permutation(len(points))[:8_000]) if not hot else np.arange(len(points))
    walked = len(points) > 16 * 32
    units = unit_rows(points)
    true = units[small] @ units.T >= 0.9
    true[np.arange(len(small)), small] = False
    found = set()
    for at, point in close_points(shard, rows, units[rows], 0.9, 0.99):
        found.update(zip(rows[at].tolist(), order[point].tolist()))
    asked = set(rows.tolist())
    judged = [all((int(q), int(p)) in found for p in np.flatnonzero(t)) for q, t in zip(small, true) if t.any() and int(q) in asked]
    assert walked and len(judged) > 1_000 and np.mean(judged) >= 0.99
    if hot:
        exact = units[7_500:7_600] @ units[7_500:].T >= 0.9
        got = sum((7_500 + i, 7_500 + j) in found for i in range(100) for j in range(hot))
        assert got >= 0.99 * exact.sum()
    assert all(units[a] @ units[b] >= 0.9 for a, b in list(found)[:5_000])


def test_links_are_not_kept(monkeypatch):
    """A block of queries in a large group comes as many small portions."""
    rng = np.random.default_rng(2)
    points = beside(rng, np.repeat(unit_rows(rng.normal(size=(1, 16))), 3_000, axis=0), 0.97, 0.999)
    shard = one_shard(points, unit_rows)
    sizes = [len(at) for at, _ in close_points(shard, np.arange(3_000), points, 0.9, 0.99)]
    assert sum(sizes) == (points @ points.T >= 0.9).sum() and max(sizes) <= 64 * 3_000


@pytest.mark.parametrize("dims", [8, 48])
def test_nearest_in_a_shard_of_thousands(dims):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(9_000, dims)) * rng.uniform(0.5, 2, (9_000, 1))
    shard = one_shard(points, lifted)
    queries = points[:300]
    found = best_points(shard, queries, 21, 0.98)
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :21]
    hits = [len(set(shard.numbers[f[f >= 0]].tolist()) & set(e.tolist())) / 21 for f, e in zip(found, exact)]
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.6


def test_a_graph_in_pieces_is_searched_whole():
    """Points that no walk reaches are found, because the widest beam is a comparison with all."""
    points = np.random.default_rng(9).normal(size=(900, 6))
    shard = one_shard(points, lifted)
    shard.graph.layers[:] = [np.full(x.shape, -1, np.int32) for x in shard.graph.layers]
    found = best_points(shard, points[:50], 20, 0.98)
    exact = np.argsort(-(points[:50] @ points.T), axis=1)[:, :20]
    assert [sorted(shard.numbers[f].tolist()) for f in found] == [sorted(e.tolist()) for e in exact]
