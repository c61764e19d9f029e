"""Samples per class, caps, splits, ranks and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions.hashing import hash32, uniform
from evenhand.operators import preference, ranking, sampling


def _ranked(source: str, keys: str, item: str) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {I.h(item)}, {item}) AS rn, "
            f"count(*) OVER (PARTITION BY {keys}) AS n FROM {source}")


@query("sample_per_class", f"WITH{I.ITEMS_SQL}" + f"""
SELECT item_id, true_class FROM ({_ranked('items', 'true_class', 'item_id')}) WHERE rn <= 20""")
def sample_per_class(spark, sf_dir):
    """Twenty rows per class by smallest hash."""
    items = I.embedding_items(spark, sf_dir)
    return sampling.sample_per_class(items, "true_class", "item_id", 20).select("item_id", "true_class")


@query("sample_budget", f"""
SELECT doc_id, lang FROM ({_ranked('documents', 'lang', 'doc_id')}) WHERE rn <= 300 // (SELECT count(DISTINCT lang) FROM documents)
""")
def sample_budget(spark, sf_dir):
    """A total budget shared evenly by the classes, cut without sorting a class."""
    documents = I.table(spark, sf_dir, "documents")
    return sampling.sample_budget_per_class(documents, "lang", "doc_id", 300).select("doc_id", "lang")


CAP = 2000


@query("cap_majority_classes", f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS c, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY c, split ORDER BY {I.h('k')}, k) AS rn FROM o)
SELECT c AS class, split, count(*) AS n, sum(k) AS key_sum, max(k) AS key_max FROM r WHERE split = 'val' OR rn <= {CAP} GROUP BY ALL
""", ints="n key_sum key_max")
def cap_majority_classes(spark, sf_dir):
    """Classes cut to a cap in the train split only; the cap is above the window limit."""
    k = F.col("o_orderkey")
    rows = I.table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_orderstatus").alias("class"), F.when(k % 10 < 8, "train").otherwise("val").alias("split"))
    kept = sampling.cap_per_class(rows, "class", "k", CAP, only=F.col("split") == "train")
    return kept.groupBy("class", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"), F.max("k").alias("key_max"))


def _allocation(name: str, size: str, held: str, previous: str) -> str:
    """One largest-remainder step of the split sizes."""
    return f"""
{name}_t AS (SELECT *, sum({size}) OVER () AS t, {held} AS hold FROM {previous}),
{name}_q AS (SELECT *, floor({size} * hold / t)::BIGINT AS q, ({size} * hold) % t AS r FROM {name}_t),
{name} AS (SELECT * EXCLUDE (t, hold, q, r),
  q + CASE WHEN row_number() OVER (ORDER BY r DESC, c) <= hold - sum(q) OVER () THEN 1 ELSE 0 END AS n_{name} FROM {name}_q)"""


SPLIT_SQL = f"""WITH d AS (SELECT doc_id, lang AS c FROM documents),
counts AS (SELECT c, count(*)::BIGINT AS n FROM d GROUP BY c),
{_allocation('train', 'n', '(sum(n) OVER () - ceil(sum(n) OVER () * 0.15::DOUBLE))::BIGINT', 'counts')},
rest AS (SELECT *, (n - n_train)::BIGINT AS m FROM train),
{_allocation('val', 'm', '(sum(m) OVER () - ceil(sum(m) OVER () * 0.333::DOUBLE))::BIGINT', 'rest')},
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY c ORDER BY {I.h('doc_id')}, doc_id) AS rn FROM d),
parts AS (SELECT doc_id, c, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
          FROM ranked JOIN val USING (c))"""


@query("stratified_split", SPLIT_SQL + " SELECT doc_id, c AS lang, split FROM parts")
def stratified_split(spark, sf_dir):
    """85/10/5 with exact sizes per class; only hash cuts are computed, documents are not shuffled."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified_split(documents, ["lang"], "doc_id", [0.15, 0.333], ["train", "validation", "test"])


@query("plain_split", f"""
SELECT o_orderkey, CASE WHEN rn <= n - ceil(n * 0.1::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {I.h('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def plain_split(spark, sf_dir):
    """90/10 without strata."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.stratified_split(orders, [], "o_orderkey", [0.1], ["train", "eval"])


@query("hash_split", f"""
SELECT o_orderkey, CASE WHEN {I.u('o_orderkey')} < 0.85 THEN 'train' WHEN {I.u('o_orderkey')} < 0.95 THEN 'validation' ELSE 'test' END AS split
FROM orders""")
def hash_split(spark, sf_dir):
    """Approximate sizes from the row's own hash, no shuffle."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.hash_split(orders, "o_orderkey", [0.85, 0.10, 0.05], ["train", "validation", "test"])


@query("predefined_split", SPLIT_SQL + " SELECT c AS lang, count(*) AS n FROM parts WHERE split = 'validation' GROUP BY c", ints="n")
def predefined_split(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = sampling.stratified_split(documents, ["lang"], "doc_id", [0.15, 0.333], ["train", "validation", "test"])
    return sampling.predefined_split(parts, "validation").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("numbered_rows", f"""
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {I.h('o_orderkey')}, o_orderkey) - 1 AS idx
FROM orders""", ints="idx")
def numbered_rows(spark, sf_dir):
    """Exact position of each row in its class, sorted only inside hash buckets."""
    rows = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", hash32(F.col("o_orderkey")).alias("h"))
    return ranking.number_rows(rows, ["o_orderstatus"], ["h", "o_orderkey"], ranking.hash_bucket(F.col("h"))).drop("h")


@query("first_records", """
SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 40""")
def first_records(spark, sf_dir):
    """The first n records in a stated order."""
    rows = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return preference.first_records(rows, ["conv_id", "turn"], 40)


@query("top_counts", """
SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 10""", ints="n")
def top_counts(spark, sf_dir):
    """Ten most frequent combinations."""
    counts = I.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "event_type", "user_id").limit(10)


@query("sorted_result", f"""
SELECT event_type, count(*) AS n, avg({I.u('event_id')}) AS mean_u FROM events GROUP BY event_type ORDER BY n DESC
""", ints="n", doubles="mean_u")
def sorted_result(spark, sf_dir):
    """Result sorted by count."""
    return I.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(uniform(F.col("event_id"))).alias("mean_u")).orderBy(F.desc("n"), "event_type")
