"""Composition, confidence and agreement audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.operators import audit, joins, principal, sampling, scoring
from evenhand.operators.metrics import pivot_grid

STRATA = I.STRATA


@query("class_composition", I.ORDERS_SQL + """,
base AS (SELECT stratum, true_class AS class, count(*) AS c FROM items GROUP BY ALL),
cells AS (SELECT * FROM base UNION ALL SELECT 'Overall', class, sum(c) FROM base GROUP BY class),
frame AS (SELECT s AS stratum, c AS class FROM (VALUES ('Light'), ('Medium'), ('Dark'), ('Overall')) a(s),
          (VALUES ('F'), ('O'), ('Z')) b(c)),
totals AS (SELECT stratum, sum(c) AS n FROM cells GROUP BY stratum)
SELECT stratum, class, n, coalesce(c, 0) AS count, coalesce(c, 0) * 100.0::DOUBLE / n AS pct
FROM frame JOIN totals USING (stratum) LEFT JOIN cells USING (stratum, class)""", ints="n count", doubles="pct")
def class_composition(spark, sf_dir):
    """Classes per stratum and overall; absent class Z is kept with 0, P only counts in n."""
    return audit.class_composition(I.order_items(spark, sf_dir), "stratum", "true_class", ["F", "O", "Z"], STRATA)


@query("source_composition", I.ORDERS_SQL + """,
named AS (SELECT stratum, CASE WHEN source = 'NATION_3' THEN 'UNKNOWN' ELSE source END AS source FROM items),
base AS (SELECT stratum, source, count(*) AS c FROM named GROUP BY ALL),
cells AS (SELECT * FROM base UNION ALL SELECT 'Overall', source, sum(c) FROM base GROUP BY source)
SELECT stratum, source, c AS count, c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY stratum) AS pct FROM cells
""", ints="count", doubles="pct")
def source_composition(spark, sf_dir):
    """Sources per stratum and overall; a NULL source (here NATION_3) is named UNKNOWN."""
    rows = I.order_items(spark, sf_dir, source=True)
    return audit.source_composition(
        rows.withColumn("source", F.when(F.col("source") != "NATION_3", F.col("source"))), "stratum", "source", STRATA)


@query("class_by_stratum_pivot", I.ORDERS_SQL + """
SELECT true_class, count(*) FILTER (WHERE stratum = 'Light') AS Light, count(*) FILTER (WHERE stratum = 'Medium') AS Medium,
       count(*) FILTER (WHERE stratum = 'Dark') AS Dark, 0 AS Absent FROM items GROUP BY ALL""",
       ints="Light Medium Dark Absent")
def class_by_stratum_pivot(spark, sf_dir):
    counts = I.order_items(spark, sf_dir).groupBy("true_class", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return pivot_grid(counts, "true_class", "stratum", "n", [*STRATA, "Absent"], fill=0)


@query("stratum_audit", f"WITH{I.ITEMS_SQL}" + """,
f AS (SELECT v AS stratum FROM (VALUES ('Light'), ('Medium'), ('Dark')) a(v)),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE flag) AS fl, count(*) FILTER (WHERE confidence >= 0.6) AS k,
             count(*) FILTER (WHERE confidence < 0.6) AS d FROM items)
SELECT 'total' AS section, unnest(['total', 'flagged', 'kept', 'filtered']) AS name, unnest([n, fl, k, d]) AS count,
       unnest([n, fl, k, d]) * 100.0::DOUBLE / n AS pct FROM t
UNION ALL SELECT 'method', method, count(*), count(*) * 100.0::DOUBLE / (SELECT n FROM t) FROM items GROUP BY method
UNION ALL SELECT 'kept', f.stratum, count(item_id), count(item_id) * 100.0::DOUBLE / (SELECT k FROM t)
  FROM f LEFT JOIN (SELECT * FROM items WHERE confidence >= 0.6) i USING (stratum) GROUP BY f.stratum
UNION ALL SELECT 'filtered', f.stratum, count(item_id), count(item_id) * 100.0::DOUBLE / (SELECT d FROM t)
  FROM f LEFT JOIN (SELECT * FROM items WHERE confidence < 0.6) i USING (stratum) GROUP BY f.stratum
""", ints="count", doubles="pct")
def stratum_audit(spark, sf_dir):
    """Totals, method shares, kept and filtered sets per stratum."""
    return audit.stratum_audit(I.embedding_items(spark, sf_dir), "stratum", STRATA, "confidence", 0.6, "flag", "method")


@query("confidence_by_class", I.VECTORS_SQL + """
SELECT model, pred_class, count(*) AS n, avg(score) AS mean_conf, stddev_pop(score) AS std_conf,
       min(score) AS min_conf, max(score) AS max_conf FROM scored GROUP BY ALL
""", ints="n", doubles="mean_conf std_conf min_conf max_conf")
def confidence_by_class(spark, sf_dir):
    return audit.confidence_by_class(I.embedding_scores(spark, sf_dir), ["model", "pred_class"], "score")


@query("confidence_by_outcome", I.VECTORS_SQL + """
SELECT model, true_class, count(*) AS n, avg(score) AS mean_conf,
       coalesce(avg(score) FILTER (WHERE true_class = pred_class), 0) AS correct_conf,
       coalesce(avg(score) FILTER (WHERE true_class <> pred_class), 0) AS incorrect_conf FROM scored GROUP BY ALL
""", ints="n", doubles="mean_conf correct_conf incorrect_conf")
def confidence_by_outcome(spark, sf_dir):
    """Mean confidence of right and wrong predictions per true class."""
    return audit.confidence_by_outcome(
        I.embedding_scores(spark, sf_dir), ["model", "true_class"], "score", F.col("true_class") == F.col("pred_class"))


@query("confidence_histogram", f"WITH{I.ITEMS_SQL}" + """,
o AS (SELECT confidence AS v, flag FROM items),
s AS (SELECT flag, min(v) AS lo, max(v) AS hi FROM o GROUP BY flag),
b AS (SELECT flag, lo, hi, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin FROM o JOIN s USING (flag))
SELECT flag, bin, lo + bin * ((hi - lo) / 50) AS low, lo + (bin + 1) * ((hi - lo) / 50) AS high, count(*) AS n
FROM b GROUP BY flag, bin, lo, hi""", ints="bin n", doubles="low high")
def confidence_histogram(spark, sf_dir):
    """Fifty equal bins over each group's own range."""
    return audit.confidence_histogram(I.embedding_items(spark, sf_dir), ["flag"], "confidence", 50)


@query("prediction_summary", f"WITH{I.ITEMS_SQL}" + """,
f AS (SELECT v AS class FROM (VALUES ('Light'), ('Medium'), ('Dark'), ('Absent')) a(v))
SELECT class, count(item_id) AS n, count(item_id) * 100.0::DOUBLE / (SELECT count(*) FROM items) AS pct,
       coalesce(avg(confidence), 0) AS mean_conf, coalesce(quantile_cont(confidence, 0.5), 0) AS median_conf
FROM f LEFT JOIN items ON class = stratum GROUP BY class""", ints="n", doubles="pct mean_conf median_conf")
def prediction_summary(spark, sf_dir):
    """Share, mean and exact median confidence per listed class."""
    return audit.prediction_summary(I.embedding_items(spark, sf_dir), "stratum", [*STRATA, "Absent"], "confidence")


@query("confidence_quantiles", I.VECTORS_SQL + """
SELECT model, unnest([0.25, 0.5, 0.75, 0.9])::DOUBLE AS prob,
       unnest(quantile_cont(score, [0.25, 0.5, 0.75, 0.9])) AS quantile FROM scored GROUP BY model
""", doubles="prob quantile")
def confidence_quantiles(spark, sf_dir):
    """Exact interpolated quantiles of continuous scores, found digit by digit."""
    from evenhand.operators.ranking import exact_quantiles

    return exact_quantiles(I.embedding_scores(spark, sf_dir), ["model"], "score", [0.25, 0.5, 0.75, 0.9])


@query("price_quantiles", """
SELECT o_orderstatus, unnest([0.0, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS prob,
       unnest(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])) AS quantile
FROM orders GROUP BY o_orderstatus""", doubles="prob quantile")
def price_quantiles(spark, sf_dir):
    """The same operator on large values and few big groups."""
    from evenhand.operators.ranking import exact_quantiles

    return exact_quantiles(
        I.table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])


@query("low_confidence_share", I.VECTORS_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE score < 0.5) AS n_low,
       count(*) FILTER (WHERE score < 0.5) * 100.0::DOUBLE / count(*) AS pct_low FROM scored
""", ints="n n_low", doubles="pct_low")
def low_confidence_share(spark, sf_dir):
    return audit.low_confidence_share(I.embedding_scores(spark, sf_dir), "score")


@query("within_one_class", I.ORDERS_SQL + """
SELECT stratum, count(*) AS n, avg((r1 = r2)::INT)::DOUBLE AS exact, avg((abs(r1 - r2) <= 1)::INT)::DOUBLE AS relaxed
FROM items GROUP BY ALL""", ints="n", doubles="exact relaxed")
def within_one_class(spark, sf_dir):
    """Ordinal accuracy within one step."""
    return audit.within_one(I.order_items(spark, sf_dir), ["stratum"], F.col("r1"), F.col("r2"))


@query("accuracy_breakdown", I.VECTORS_SQL + """,
r AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 'high' ELSE 'low' END AS tier FROM scored WHERE model = 'lambda10')
SELECT 'method' AS facet, method AS value, count(*) AS n, avg((true_class = pred_class)::INT)::DOUBLE AS accuracy FROM r GROUP BY ALL
UNION ALL SELECT 'tier', tier, count(*), avg((true_class = pred_class)::INT)::DOUBLE FROM r GROUP BY ALL
""", ints="n", doubles="accuracy")
def accuracy_breakdown(spark, sf_dir):
    """Accuracy by method and by confidence tier from one aggregation."""
    from evenhand.functions.labels import tier

    rows = I.embedding_scores(spark, sf_dir, {"lambda10": 64}).withColumn("tier", tier(F.col("confidence"), 0.6))
    return audit.accuracy_breakdown(rows, ["method", "tier"], F.col("true_class") == F.col("pred_class"))


@query("either_rater_confidence", I.VECTORS_SQL + """,
p AS (SELECT item_id, max(true_class) AS t, max(confidence) AS confidence,
      max(CASE WHEN model = 'lambda10' THEN pred_class END) AS a, max(CASE WHEN model = 'lambda07' THEN pred_class END) AS b
      FROM scored GROUP BY item_id)
SELECT count(*) AS n, count(*) FILTER (WHERE t = a OR t = b) AS n_either, avg(confidence) AS mean_conf,
       avg(confidence) FILTER (WHERE t = a OR t = b) AS conf_either,
       avg(confidence) FILTER (WHERE NOT (t = a OR t = b)) AS conf_neither FROM p
""", ints="n n_either", doubles="mean_conf conf_either conf_neither")
def either_rater_confidence(spark, sf_dir):
    """Two models play the raters: confidence where at least one agrees."""
    rows = I.embedding_scores(spark, sf_dir, {"lambda10": 64, "lambda07": 48})
    pair = rows.groupBy("item_id").agg(
        F.max("true_class").alias("t"), F.max("confidence").alias("confidence"),
        *[F.max(F.when(F.col("model") == m, F.col("pred_class"))).alias(m) for m in ("lambda10", "lambda07")])
    return audit.either_rater(pair, F.col("t"), [F.col("lambda10"), F.col("lambda07")], "confidence")


@query("side_by_side_counts", I.ORDERS_SQL + """,
f AS (SELECT v AS class FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) a(v)),
a AS (SELECT r1 AS class, count(*) AS c FROM items GROUP BY 1), b AS (SELECT r2 AS class, count(*) AS c FROM items GROUP BY 1)
SELECT 'k' || class AS class, coalesce(a.c, 0) AS n_k1, coalesce(b.c, 0) AS n_k2
FROM f LEFT JOIN a USING (class) LEFT JOIN b USING (class)""", ints="n_k1 n_k2")
def side_by_side_counts(spark, sf_dir):
    """Counts of two rating columns over listed classes, zeros kept."""
    rows = I.order_items(spark, sf_dir).select(*[
        F.concat(F.lit("k"), F.col(r).cast("string")).alias(f"k{i}") for i, r in ((1, "r1"), (2, "r2"))])
    return audit.side_by_side_counts(rows, ["k1", "k2"], [f"k{i}" for i in range(1, 8)])


@query("row_accounting", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE text IS NULL) AS no_text,
       count(DISTINCT lang) AS distinct_lang, count(DISTINCT source) AS distinct_source FROM documents
""", ints="n_rows short no_text distinct_lang distinct_source")
def row_accounting(spark, sf_dir):
    return audit.row_accounting(
        I.table(spark, sf_dir, "documents"), {"short": F.col("n_chars") < 500, "no_text": F.col("text").isNull()},
        ["lang", "source"])


VIEWS_SQL = I.VECTORS_SQL + """,
views AS (SELECT item_id, k, avg(p) AS p, count(*) AS n_views FROM probs GROUP BY ALL)"""


@query("average_views", VIEWS_SQL + """
SELECT item_id, any_value(n_views) AS n_views, arg_max(k, p) AS pred_class, max(p) AS confidence
FROM views GROUP BY item_id""", ints="n_views", doubles="confidence")
def average_views(spark, sf_dir):
    """Scores averaged over the views of an item, then arg-max."""
    return audit.average_views(I.embedding_scores(spark, sf_dir), ["item_id"], "probs", 10, I.VECTOR_CLASSES).drop("probs")


@query("patch_probability_consensus", VIEWS_SQL + """
SELECT k AS class, avg(p) AS mean_p, max(p) AS max_p FROM views GROUP BY k""", doubles="mean_p max_p")
def patch_probability_consensus(spark, sf_dir):
    """Mean probability vector over the patches of an item, summarised per class."""
    means = audit.average_views(I.embedding_scores(spark, sf_dir), ["item_id"], "probs", 10, I.VECTOR_CLASSES)
    long = means.select(F.posexplode("probs").alias("k", "p"))
    return long.groupBy(F.concat(F.lit("c"), F.col("k").cast("string")).alias("class")).agg(
        F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))


@query("sampled_principal_components", None, doubles="pc1 pc2 pc3")
def sampled_principal_components(spark, sf_dir):
    """PCA of a stratified subsample; the sign of a component is free, so sizes are returned."""
    items = I.embedding_items(spark, sf_dir)
    sample = sampling.sample_per_class(items, "true_class", "item_id", 100)
    return audit.pca_projection(sample, "item_id", "embedding", 50).select(
        "item_id", *[F.abs(F.get("pca", F.lit(i))).alias(f"pc{i + 1}") for i in range(3)])


def _strongest(matrix: str, name: str, levels: int = 18) -> str:
    """CTEs for the first eigenvector ``name``_vector and value ``name``_value of a matrix (i, j, v), by repeated squaring."""
    text, last = f"{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})", f"{name}0"
    for t in range(1, levels + 1):
        text += f""",
{name}{t}p AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j),
{name}{t} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}{t}p WHERE i = j) AS v FROM {name}{t}p)"""
        last = f"{name}{t}"
    return text + f""",
{name}_raw AS MATERIALIZED (
  SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)),
{name}_vector AS MATERIALIZED (SELECT i, v * (SELECT CASE WHEN arg_max(v, abs(v)) < 0 THEN -1 ELSE 1 END FROM {name}_raw) AS v FROM {name}_raw),
{name}_value AS MATERIALIZED (
  SELECT sum(a.v * m.v * b.v) AS v FROM {matrix} m JOIN {name}_vector a ON a.i = m.i JOIN {name}_vector b ON b.i = m.j)"""


COMPONENTS_SQL = f"""WITH x AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
centred AS MATERIALIZED (SELECT vec_id, label, i, v - m AS v FROM x JOIN means USING (i)),
covariance AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
{_strongest("covariance", "one")},
rest AS MATERIALIZED (
  SELECT c.i, c.j, c.v - (SELECT v FROM one_value) * a.v * b.v AS v FROM covariance c
  JOIN one_vector a ON a.i = c.i JOIN one_vector b ON b.i = c.j),
{_strongest("rest", "two")},
total AS (SELECT sum(v) AS total FROM covariance WHERE i = j)"""


@query("principal_components", COMPONENTS_SQL + """
SELECT component, v AS variance, v / total AS share, total
FROM (SELECT 1 AS component, v FROM one_value UNION ALL SELECT 2, v FROM two_value), total""",
       ints="component", doubles="variance share total")
def principal_components(spark, sf_dir):
    """Variances along the first two components of all rows, and the total."""
    found = principal.principal_components(I.embedding_items(spark, sf_dir), "embedding", 64, 2)
    return principal.component_table(spark, found)


@query("projected_class_means", COMPONENTS_SQL + """,
projected AS (
  SELECT vec_id, label, sum(c.v * a.v) AS pc1, sum(c.v * b.v) AS pc2 FROM centred c
  JOIN one_vector a ON a.i = c.i JOIN two_vector b ON b.i = c.i GROUP BY vec_id, label)
SELECT 'c' || label AS class, avg(pc1) AS pc1, avg(pc2) AS pc2, var_samp(pc1) AS spread1 FROM projected GROUP BY label""",
       doubles="pc1 pc2 spread1")
def projected_class_means(spark, sf_dir):
    """Class means along the first two components, signs fixed by the largest coordinate."""
    items = I.embedding_items(spark, sf_dir)
    found = principal.principal_components(items, "embedding", 64, 2)
    rows = items.select("true_class", principal.projected(found, "embedding").alias("pc"))
    return rows.groupBy(F.col("true_class").alias("class")).agg(
        F.avg(F.get("pc", F.lit(0))).alias("pc1"), F.avg(F.get("pc", F.lit(1))).alias("pc2"),
        F.var_samp(F.get("pc", F.lit(0))).alias("spread1"))


@query("rater_bridge", I.ORDERS_SQL + """,
pairs AS (SELECT DISTINCT item_id, source AS tag FROM items),
ratings AS (SELECT DISTINCT source AS tag, r1, r2 FROM items WHERE r1 = r2)
SELECT tag, r1, r2, count(*) AS n FROM pairs JOIN ratings USING (tag) GROUP BY ALL""", ints="r1 r2 n")
def rater_bridge(spark, sf_dir):
    """Items joined through a tag to all distinct ratings of the tag."""
    items = I.order_items(spark, sf_dir, source=True).withColumnRenamed("source", "tag")
    merged = joins.bridge_raters(
        items.select("item_id"), items.select("item_id", "tag"), items.where("r1 = r2").select("tag", "r1", "r2"),
        "item_id", "tag", ["r1", "r2"])
    return merged.groupBy("tag", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_mean_accuracy", I.VECTORS_SQL + """
SELECT model, count(*) AS n, count(*) FILTER (WHERE true_class = pred_class) AS hits,
       sum(CAST(substr(pred_class, 2) AS BIGINT)) AS pred_sum FROM scored GROUP BY model""", ints="n hits pred_sum")
def nearest_mean_accuracy(spark, sf_dir):
    """Nearest class mean over five prefixes of the vector, all models in one pass."""
    return I.embedding_scores(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("true_class") == F.col("pred_class")).alias("hits"),
        F.sum(F.substring("pred_class", 2, 2).cast("bigint")).alias("pred_sum"))


@query("class_mean_vectors", I.VECTORS_SQL + " SELECT k AS class, d - 1 AS dim, m AS value FROM means",
       ints="dim", doubles="value")
def class_mean_vectors(spark, sf_dir):
    means = scoring.class_means(I.embedding_items(spark, sf_dir), "true_class", "embedding", 64)
    return means.select("class", F.posexplode("mean").alias("dim", "value"))
