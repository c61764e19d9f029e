"""State between runs: stored cells, sketches, buckets, counted writes, replayed batches; components of all rows."""

import json
import shutil

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from catalog.upkeep import colocated_predictions
from evenhand.functions.hashing import hash32
from evenhand.operators import audit, balance, colocated, incremental, metrics, principal, sketches
from evenhand.operators.colocated import shuffles_on
from evenhand.operators.ranking import exact_quantiles
from evenhand.sources import sinks
from evenhand.streaming.exactly_once import read_batches, run_batches
from evenhand.streaming.rowwise import read_record_stream

PREDICTIONS = "stratum string, true_class string, pred_class string"


@pytest.fixture
def kept(spark, tmp_path):
    """(write a file, run an update, read the cells) on fresh folders."""
    folder, store = str(tmp_path / "in"), str(tmp_path / "cells")

    def write(name, rows):
        spark.createDataFrame(rows, PREDICTIONS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    def update():
        return incremental.update_cells(
            spark, folder, store, lambda paths: spark.read.schema(PREDICTIONS).parquet(*paths),
            lambda df, files: metrics.confusion_cells(df, [*files, "stratum"]))

    def cells():
        found = incremental.current_cells(spark, folder, store, ["n"])
        return {(r["stratum"], r["true_class"], r["pred_class"]): r["n"] for r in found.collect()}

    return write, update, cells, tmp_path


def test_only_new_files_are_read_and_all_count(kept):
    write, update, cells, _ = kept
    write("a", [("x", "F", "F")] * 3 + [("y", "F", "O")])
    assert update() == 1 and cells() == {("x", "F", "F"): 3, ("y", "F", "O"): 1}
    write("b", [("x", "F", "F"), (None, "O", None)])
    assert update() == 1 and update() == 0
    assert cells() == {("x", "F", "F"): 4, ("y", "F", "O"): 1, (None, "O", None): 1}


def test_changed_missing_and_empty_files(kept, spark):
    write, update, cells, top = kept
    write("a", [("x", "F", "F")] * 3)
    write("empty", [])
    assert update() == 2 and update() == 0 and cells() == {("x", "F", "F"): 3}
    write("a", [("x", "F", "O")] * 2)
    assert update() == 1 and cells() == {("x", "F", "O"): 2}
    write("b", [("y", "P", "P")])
    update()
    shutil.rmtree(top / "in" / "a")
    assert update() == 0 and cells() == {("y", "P", "P"): 1}
    with pytest.raises(FileNotFoundError):
        incremental.current_cells(spark, str(top / "in"), str(top / "nothing"), ["n"])


def test_files_added_by_two_runs_count_once(kept, spark):
    write, update, cells, top = kept
    write("a", [("x", "F", "F")] * 3)
    assert update() == 1
    twice = spark.read.parquet(str(top / "cells")).withColumn("_run", F.lit("zz"))
    twice.write.parquet(str(top / "other"))
    spark.read.parquet(str(top / "other")).write.mode("append").parquet(str(top / "cells"))
    assert cells() == {("x", "F", "F"): 3}


def test_sketches_merge_and_keep_their_error(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.lognormal(size=20_000)] + [("b", float(x)) for x in rng.integers(0, 9, 300)]
    rows += [("b", None), ("b", float("nan")), ("none", None)]
    spark.createDataFrame(rows, "g string, v double").repartition(3).write.parquet(str(tmp_path / "v"))
    table = spark.read.parquet(str(tmp_path / "v"))
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    parts = sketches.file_sketches(table, ["g"], "v")
    assert parts.select("file").distinct().count() == 3
    merged = sketches.merged_sketches(parts, ["g"])
    whole = sketches.value_sketches(table, ["g"], "v")
    values = {g: np.sort([v for k, v in rows if k == g and v is not None and v == v]) for g in ("a", "b")}
    for state in (merged, whole):
        for r in sketches.sketched_quantiles(state, ["g"], probs).collect():
            data = values[r["g"]]
            assert r["n"] == len(data)
            low, high = np.searchsorted(data, r["quantile"], "left"), np.searchsorted(data, r["quantile"], "right")
            assert low / len(data) - 2 * sketches.rank_error() <= r["prob"] <= high / len(data) + 2 * sketches.rank_error()
    small = lambda state: sorted(map(tuple, sketches.sketched_quantiles(state.where("g = 'b'"), ["g"], probs).collect()))
    assert small(merged) == small(whole)  # fewer values than a sketch holds: the same answer from parts and in one pass
    exact = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(table.where("v is not null and not isnan(v)"), ["g"], "v", probs).collect()}
    assert all(abs(q - exact[g, p]) <= 1 for g, _, p, q in small(merged))


def test_write_counts_what_it_writes(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v")).write.parquet(source)
    table = spark.read.parquet(source)
    got = audit.write_with_accounting(table, path, {"missing": F.col("v").isNull(), "large": F.col("v") > 50}, F.col("v") > 20)
    assert got == {"n_rows": 100, "missing": 10, "large": 45, "n_kept": 72} and spark.read.parquet(path).count() == 72
    none = audit.write_with_accounting(table.where("id < 0"), path, {"missing": F.col("v").isNull()})
    assert none == {"n_rows": 0, "missing": 0, "n_kept": 0}
    plan = table.observe("x", F.count(F.lit(1)).alias("n")).where("v > 20").observe("y", F.count(F.lit(1)).alias("n"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bucketed_tables_meet_without_a_shuffle(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paired = colocated_predictions(spark, sf_dir)
        assert shuffles_on(paired, "item_id") == 0
        assert "SortMergeJoin" in paired._jdf.queryExecution().executedPlan().toString()
        spread = spark.createDataFrame([(1, 2)], "item_id long, v long").repartition(3, "item_id")
        assert shuffles_on(spread, "item_id") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_grow_with_the_rows(spark, sf_dir, monkeypatch):
    """A bucket is one task's work: more rows make more buckets, not longer ones, and the same pairs."""
    want = sorted(map(str, colocated_predictions(spark, sf_dir).collect()))
    n = 5 * spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    monkeypatch.setattr(colocated, "BUCKET_ROWS", n // 20)
    paired = colocated_predictions(spark, sf_dir)
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert f"out of {-(-n // (n // 20))}" in plan and "out of 8" not in plan
    assert shuffles_on(paired, "item_id") == 0
    assert sorted(map(str, paired.collect())) == want


def test_a_batch_that_was_written_but_not_committed_is_not_doubled(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = T.StructType().add("id", "long")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(source)

    def run(fail_at=None):
        def stop(number):
            if number == fail_at:
                raise RuntimeError("stopped")

        stream = read_record_stream(spark, source, schema, "parquet", files_per_trigger=1)
        run_batches(stream, lambda b: b.withColumn("id", F.col("id") + 1), out, state, after_write=stop)

    assert read_batches(spark, out, schema).count() == 0
    with pytest.raises(StreamingQueryException):
        run(fail_at=1)
    assert read_batches(spark, out, schema).count() == 20  # the second batch is there, but not committed
    run()
    assert sorted(r["id"] for r in read_batches(spark, out, schema).collect()) == list(range(1, 31))
    run()
    assert read_batches(spark, out, schema).count() == 30


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_rotations_find_the_eigenvectors(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    matrix = a @ a.T
    values, vectors = principal.jacobi(matrix)
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(matrix)) and np.allclose(vectors.T @ vectors, np.eye(n))
    assert np.allclose(matrix @ vectors, vectors * values)
    assert np.allclose(principal.jacobi(np.zeros((n, n)))[0], 0)


def test_components_of_all_rows(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(700, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1e6
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] + [0.0] * 5), (903, [None] + [0.0] * 5)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + odd, "id long, f array<double>").repartition(5)
    found = principal.principal_components(table, "f", 6, 3)
    values, vectors = np.linalg.eigh(np.cov(data.T))
    assert found.n == 700 and np.allclose(found.mean, data.mean(axis=0)) and np.isclose(found.total, values.sum())
    assert np.allclose(found.variances, values[::-1][:3], rtol=1e-8)
    want = principal.signed(vectors.T[::-1][:3])
    assert np.allclose(found.vectors, want, atol=1e-6)
    got = table.where("id < 700").select("id", principal.projected(found, "f").alias("p")).orderBy("id").collect()
    assert np.allclose([r["p"] for r in got], (data - data.mean(axis=0)) @ want.T, atol=1e-4)
    empty = principal.principal_components(table.where("id < 0"), "f", 6, 2)
    assert empty.n == 0 and (empty.variances == 0).all()


def test_a_report_of_a_growing_table_fails(spark):
    table = spark.range(30).select("id")
    assert json.loads(sinks.report_json({"t": table}, most_rows=30).first()["value"])["t"][29] == {"id": 29}
    with pytest.raises(Exception, match="more than 29 rows"):
        sinks.report_json({"t": table}, most_rows=29).collect()


def test_a_large_pool_is_cut_to_the_attempts(spark):
    """The same attempts as from the whole pool in hash order, although few of its rows are numbered."""
    deficits = spark.createDataFrame([("a", 3, 5, 2, "b"), ("b", 5, 5, 0, "a")], "class string, n long, target long, deficit long, donor string")
    sources = spark.range(5_000).select(F.lit("a").alias("target"), F.col("id").alias("source_id"), F.lit("b").alias("source_class"))
    references = spark.createDataFrame([("a", 1), ("a", 2)], "target string, reference_id long")
    got = balance.candidate_attempts(sources, references, deficits, 1.5, 4).orderBy("attempt").collect()
    order = sources.select("source_id", hash32(F.lit("source"), F.lit("a"), F.col("source_id")).alias("h")).orderBy("h", "source_id")
    assert [r["source_id"] for r in got] == [r["source_id"] for r in order.limit(15).collect()]
    assert [r["attempt"] for r in got] == list(range(15))
