import collections

import pytest
from helpers import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evenhand.llm.mixing import emit, mix, source_targets


def fill(sizes, weights, most=3):
    """Share the sum by weight and reshare what lies above the caps until nothing does."""
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        rest = sum(weights[s] for s in free)
        left = total - sum(capped.values())
        share = {s: left * weights[s] / rest for s in free}
        above = [s for s in free if share[s] >= most * sizes[s]]
        if not above:
            return share | capped
        capped |= {s: most * sizes[s] for s in above}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_equal_repeated_resharing(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    table = spark.createDataFrame([(n, s) for n, s in zip(names, sizes)], "_src string, source_size long")
    got = {r["_src"]: r.target for r in source_targets(table, (1, 2, 3)).collect()}
    want = fill(dict(zip(names, sizes)), {n: 1 + i % 3 for i, n in enumerate(names)})
    assert got == pytest.approx(want)


def test_awkward_rows(spark, docs):
    mixed = mix(docs)
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len((r[1] or "").encode().split())
    assert all(r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    order = sorted(k for k in sizes if k is not None) + [None]
    want = fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    assert {r.source: r.target for r in got} == pytest.approx(want)
    again = mix(docs.repartition(11)).select("doc_id", "copies").collect()
    assert collections.Counter(tuple(r) for r in again) == collections.Counter((r.doc_id, r.copies) for r in got)
    assert emit(mixed).count() == sum(r.copies for r in got)


def test_copies_stay_near_the_target_in_a_hot_source(spark):
    content = [(i, "w " * (1 + i % 50), "en", "hot" if i % 3 else f"s{i % 30}", 0) for i in range(3000)]
    from helpers import documents

    got = mix(documents(spark, content)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 60 for r in got)


def test_empty_table(no_docs):
    assert mix(no_docs).count() == 0 and emit(mix(no_docs)).count() == 0
