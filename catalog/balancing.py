"""Deficits, quotas, candidate pairs, acceptance, weights and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions import arrays as A
from evenhand.operators import balance, realism
from evenhand.plans.balancing import balance_classes

RATIOS = [0.0, 0.3, 0.7, 1.0]
STRATA = I.STRATA
ITEMS = f"WITH{I.ITEMS_SQL}"


def _items(spark, sf_dir):
    return I.embedding_items(spark, sf_dir)


def _deficits(spark, sf_dir):
    return balance.class_deficits(_items(spark, sf_dir), "stratum")


@query("class_deficits", ITEMS + """,
c AS (SELECT v AS class, count(item_id) AS n FROM (VALUES ('Light'), ('Medium'), ('Dark'), ('None')) f(v)
      LEFT JOIN items ON v = stratum GROUP BY v),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, class) AS rn FROM c)
SELECT class, n, 400 AS target, greatest(400 - n, 0) AS deficit,
       CASE WHEN rn = 1 THEN (SELECT class FROM r WHERE rn = 2) ELSE (SELECT class FROM r WHERE rn = 1) END AS donor FROM r
""", ints="n target deficit")
def class_deficits(spark, sf_dir):
    """Missing rows per class up to a target, with the largest other class as donor."""
    return balance.class_deficits(_items(spark, sf_dir), "stratum", 400, [*STRATA, "None"])


DEFICIT_SQL = ITEMS + """,
counts AS (SELECT stratum AS class, count(*) AS n FROM items GROUP BY 1),
def AS (SELECT class, n, max(n) OVER () - n AS deficit FROM counts),
ratios(ratio) AS (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.7::DOUBLE), (1.0::DOUBLE)),
q1 AS (SELECT ratio, class, deficit, round_even(deficit * ratio, 0)::BIGINT AS q FROM def CROSS JOIN ratios),
quotas AS (SELECT ratio, class, 'reinhard' AS method, q AS quota FROM q1 UNION ALL
           SELECT ratio, class, 'deep_blend', deficit - q FROM q1)"""


@query("method_quotas", DEFICIT_SQL + " SELECT * FROM quotas", ints="quota", doubles="ratio")
def method_quotas(spark, sf_dir):
    """Half-even rounded share of the first method, for four ratios."""
    return balance.method_quotas(_deficits(spark, sf_dir), RATIOS)


ATTEMPT_SQL = DEFICIT_SQL + f""",
plan AS (SELECT class AS target, floor(deficit * 1.5::DOUBLE)::BIGINT AS pc,
                floor(deficit * 1.5::DOUBLE)::BIGINT * 3 + deficit * 3 AS a FROM def WHERE deficit > 0),
src AS (SELECT target, item_id AS source_id, stratum AS source_class, a, pc,
   row_number() OVER (PARTITION BY target ORDER BY {I.h("'source'", 'target', 'item_id')}, item_id) - 1 AS idx
   FROM items JOIN plan ON stratum <> target),
used AS (SELECT *, count(*) OVER (PARTITION BY target) AS pool FROM src WHERE idx < a),
tries AS (SELECT target, pc, source_id, source_class, unnest(range(idx, a, pool)) AS attempt FROM used),
given AS (SELECT stratum AS target, item_id AS reference_id FROM items WHERE method = 'ring' AND stratum <> 'Dark'
          UNION ALL SELECT stratum, item_id FROM items WHERE stratum = 'Dark'),
refs AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {I.h("'order'", 'target', 'reference_id')}, reference_id) - 1 AS rix,
                count(*) OVER (PARTITION BY target) AS nr FROM given),
attempts AS (SELECT t.target, attempt, least(attempt // pc, 3) + 1 AS cycle, source_id, source_class, reference_id
  FROM tries t JOIN refs r ON r.target = t.target AND {I.h("'reference'", 't.target', 'attempt')} % nr = rix)"""


def _pools(spark, sf_dir):
    items, deficits = _items(spark, sf_dir), _deficits(spark, sf_dir)
    given = items.where((F.col("method") == "ring") & (F.col("stratum") != "Dark"))
    sources = balance.source_pool(items, "stratum", "item_id", deficits)
    references = balance.reference_pool(given, items, "stratum", "item_id", deficits)
    return sources, references, deficits


def _attempts(spark, sf_dir):
    return balance.candidate_attempts(*_pools(spark, sf_dir))


@query("source_and_reference_pools", ATTEMPT_SQL + """
SELECT 'source' AS pool, target, count(*) AS n, sum(source_id) AS id_sum FROM src GROUP BY ALL
UNION ALL SELECT 'reference', target, count(*), sum(reference_id) FROM refs WHERE target <> 'Light' GROUP BY ALL""", ints="n id_sum")
def source_and_reference_pools(spark, sf_dir):
    """Sources are all other classes; a class without references falls back to its own rows."""
    sources, references, _ = _pools(spark, sf_dir)
    both = sources.select(F.lit("source").alias("pool"), "target", F.col("source_id").alias("id")).unionByName(
        references.select(F.lit("reference").alias("pool"), "target", F.col("reference_id").alias("id")))
    return both.groupBy("pool", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("candidate_pairs", ATTEMPT_SQL + " SELECT * FROM attempts", ints="attempt cycle")
def candidate_pairs(spark, sf_dir):
    """Every attempt of every cycle: round-robin source and hash-chosen reference."""
    return _attempts(spark, sf_dir)


BORDER = A.border_positions(8, 8, 1)
CENTRE = A.centre_positions(8, 8, 1)
RULES = [("dark_border", "border_mean", None, -0.012), ("bright_center", "center_mean", 0.055, None)]
GATED_SQL = ATTEMPT_SQL + f""",
vals AS (SELECT item_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM items),
stats AS (SELECT item_id, avg(v) AS m, stddev_pop(v) AS s FROM vals GROUP BY item_id),
moved AS (SELECT target, attempt, i, least(greatest((v - a.m) * (b.s / greatest(a.s, 1e-6)) + b.m, -0.25), 0.25) AS v
  FROM attempts JOIN stats a ON a.item_id = source_id JOIN stats b ON b.item_id = reference_id JOIN vals ON vals.item_id = source_id),
feats AS (SELECT target, attempt, avg(v) FILTER (WHERE i IN {tuple(BORDER)}) AS border_mean,
                 avg(v) FILTER (WHERE i IN {tuple(CENTRE)}) AS center_mean FROM moved GROUP BY ALL),
reasons AS (SELECT *, CASE WHEN border_mean < -0.012 THEN 'dark_border' WHEN center_mean > 0.055 THEN 'bright_center' ELSE 'ok' END AS reason FROM feats),
gated AS (SELECT ratio, target, attempt, reason, CASE WHEN {I.u("'method'", 'target', 'attempt')} < ratio THEN 'reinhard' ELSE 'deep_blend' END AS method
          FROM reasons CROSS JOIN ratios),
okays AS (SELECT *, row_number() OVER (PARTITION BY ratio, target, method ORDER BY attempt) AS rn FROM gated WHERE reason = 'ok'),
accepted AS (SELECT o.ratio, o.target, o.method, attempt FROM okays o JOIN quotas k ON k.ratio = o.ratio AND k.class = o.target AND k.method = o.method
             WHERE rn <= quota)"""


def _recolour_and_gate(spark, sf_dir):
    """Gate step: the recoloured source array of each attempt put through two realism rules."""
    cells = I.arrays_8x8(spark, sf_dir).select("item_id", "cells")
    stats = cells.select("item_id", "cells", A.mean(F.col("cells")).alias("m"), A.std_pop(F.col("cells")).alias("s"))
    source = stats.select(F.col("item_id").alias("source_id"), "cells", F.col("m").alias("sm"), F.col("s").alias("ss"))
    reference = stats.select(F.col("item_id").alias("reference_id"), F.col("m").alias("tm"), F.col("s").alias("ts"))

    def step(attempts):
        rows = attempts.join(source, "source_id").join(reference, "reference_id")
        moved = rows.withColumn("moved", A.transfer_channel(
            F.col("cells"), F.col("sm"), F.col("ss"), F.col("tm"), F.col("ts"), -0.25, 0.25))
        feats = moved.withColumns({
            "border_mean": A.mean(A.region(F.col("moved"), BORDER)),
            "center_mean": A.mean(A.region(F.col("moved"), CENTRE))})
        return feats.withColumn("reason", realism.realism_reason(RULES)).select(*attempts.columns, "reason")

    return step


def _balanced(spark, sf_dir):
    items = _items(spark, sf_dir).select("item_id", "stratum", "method")
    given = items.where((F.col("method") == "ring") & (F.col("stratum") != "Dark"))
    return balance_classes(items, given, "stratum", "item_id", _recolour_and_gate(spark, sf_dir), RATIOS)


@query("accepted_attempts", GATED_SQL + " SELECT ratio, target, method, attempt FROM accepted", ints="attempt", doubles="ratio")
def accepted_attempts(spark, sf_dir):
    """Passing attempts until each method's quota is full, four ratios in one job."""
    return _balanced(spark, sf_dir).accepted.select("ratio", "target", "method", "attempt")


@query("rejection_reasons", GATED_SQL + """,
need AS (SELECT ratio, class AS target, sum(quota) AS need FROM quotas GROUP BY ALL),
got AS (SELECT ratio, target, count(*) AS got, max(attempt) AS last FROM accepted GROUP BY ALL)
SELECT g.ratio, reason, count(*) AS n FROM gated g JOIN need USING (ratio, target) LEFT JOIN got USING (ratio, target)
WHERE reason <> 'ok' AND (got IS NULL OR got < need OR attempt <= last) GROUP BY ALL""", ints="n", doubles="ratio")
def rejection_reasons(spark, sf_dir):
    return _balanced(spark, sf_dir).reasons


@query("lineage_manifest", GATED_SQL + """
SELECT ratio, source_id || '_to_' || target || '_' || method || '_' || lpad(CAST(attempt AS VARCHAR), 9, '0') || '.jpg' AS output_name,
       source_id, source_class, reference_id, target AS reference_class, method, target AS target_class
FROM accepted JOIN attempts USING (target, attempt)""", doubles="ratio")
def lineage_manifest(spark, sf_dir):
    """Manifest of the accepted synthetic items."""
    return _balanced(spark, sf_dir).manifest


@query("balance_report", GATED_SQL + """,
a AS (SELECT ratio, target AS class, count(*) AS acc, count(*) FILTER (WHERE method = 'reinhard') AS acc1 FROM accepted GROUP BY ALL),
f AS (SELECT ratio, class, n, deficit, coalesce(acc, 0) AS accepted, coalesce(acc1, 0) AS accepted_first
      FROM def CROSS JOIN ratios LEFT JOIN a USING (ratio, class)),
g AS (SELECT *, CASE WHEN accepted > 0 THEN accepted_first::DOUBLE / accepted ELSE 0 END AS actual_ratio FROM f)
SELECT *, deficit - accepted AS shortfall, accepted > 0 AND abs(actual_ratio - ratio) > 0.05 AS drift, n + accepted AS final_n FROM g
""", ints="n deficit accepted accepted_first shortfall final_n", doubles="ratio actual_ratio")
def balance_report(spark, sf_dir):
    """Shortfall, drift of the ratio and final distribution."""
    return _balanced(spark, sf_dir).report


@query("class_tiers", """
WITH c AS (SELECT source AS class, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT *, n::DOUBLE / sum(n) OVER () AS share FROM c)
SELECT *, CASE WHEN share < 0.19 THEN 'severe' WHEN share < 0.21 THEN 'minority' ELSE 'regular' END AS tier FROM s
""", ints="n", doubles="share")
def class_tiers(spark, sf_dir):
    counts = balance.class_counts(I.table(spark, sf_dir, "documents"), "source")
    return balance.class_tiers(counts, 0.19, 0.21)


STRATEGY_SQL = {
    "inverse": "1.0::DOUBLE / n", "sqrt": "1.0::DOUBLE / sqrt(n)", "temperature": "pow(1.0::DOUBLE / n, 0.3)",
    "capped": "least(mx::DOUBLE / n, 2.0) / mx",
    "capped_ref": "CASE WHEN (1.0::DOUBLE / n) * mx / n > 0.01 THEN 0.01::DOUBLE * n / mx ELSE 1.0::DOUBLE / n END",
}
WEIGHT_SQL = ITEMS + """,
c AS (SELECT v AS class, count(item_id) AS n0 FROM (VALUES ('Light'), ('Medium'), ('Dark'), ('None')) f(v)
      LEFT JOIN items ON v = stratum GROUP BY v),
m AS (SELECT *, greatest(n0, 1) AS n, max(greatest(n0, 1)) OVER () AS mx FROM c),
w AS (""" + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, class, n0, n, {x} AS raw FROM m" for s, x in STRATEGY_SQL.items()) + """),
z AS (SELECT strategy, class, n0 AS n, raw / sum(raw) OVER (PARTITION BY strategy) AS weight,
             n::DOUBLE / sum(n) OVER (PARTITION BY strategy) AS natural_share FROM w)
SELECT *, weight / natural_share AS oversample FROM z"""


@query("sampling_weights", WEIGHT_SQL, ints="n", doubles="weight natural_share oversample")
def sampling_weights(spark, sf_dir):
    """Five weighting strategies over the class counts."""
    counts = balance.class_counts(_items(spark, sf_dir), "stratum", [*STRATA, "None"])
    tables = [
        balance.class_weights(counts, s, 0.3, 0.01 if s == "capped_ref" else 2.0).withColumn("strategy", F.lit(s))
        for s in balance.WEIGHT_STRATEGIES]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


@query("loss_weights", ITEMS + """,
c AS (SELECT stratum AS class, count(*) AS n FROM items GROUP BY 1),
s AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k, sum(1.0::DOUBLE / sqrt(n)) OVER () AS rs FROM c)
SELECT class, n, total::DOUBLE / (k * n) AS balanced, 1.0::DOUBLE / sqrt(n) * k / rs AS inverse_sqrt FROM s
UNION ALL SELECT 'None', 0, 1.0, NULL""", ints="n", doubles="balanced inverse_sqrt")
def loss_weights(spark, sf_dir):
    items = _items(spark, sf_dir)
    full = balance.loss_weights(balance.class_counts(items, "stratum", [*STRATA, "None"])).withColumnRenamed("weight", "balanced")
    root = balance.loss_weights(balance.class_counts(items, "stratum"), "inverse_sqrt").withColumnRenamed("weight", "inverse_sqrt")
    return full.join(root.drop("n"), "class", "left")


@query("row_weights", ITEMS + """,
c AS (SELECT stratum AS class, count(*) AS n FROM items GROUP BY 1),
w AS (SELECT class, (1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER () AS weight FROM c)
SELECT stratum, count(*) AS n, sum(weight) AS weight_sum FROM items JOIN w ON class = stratum GROUP BY stratum""", ints="n", doubles="weight_sum")
def row_weights(spark, sf_dir):
    """Class weight attached to each row, for weighted losses."""
    items = _items(spark, sf_dir)
    weights = balance.class_weights(balance.class_counts(items, "stratum"), "inverse")
    return balance.with_class_weight(items, "stratum", weights).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight_sum"))


@query("weighted_draw", ITEMS + f""",
c AS (SELECT stratum AS class, count(*) AS n FROM items GROUP BY 1),
w AS (SELECT *, pow(1.0::DOUBLE / n, 0.3) / sum(pow(1.0::DOUBLE / n, 0.3)) OVER () AS weight FROM c),
e AS (SELECT class, sum(n) OVER () * 2 * weight / sum(n * weight) OVER () AS e FROM w),
d AS (SELECT item_id, stratum, floor(e) + CASE WHEN {I.u("'draw'", 'item_id')} < e - floor(e) THEN 1 ELSE 0 END AS k
      FROM items JOIN e ON class = stratum)
SELECT item_id, stratum, unnest(range(1, k::BIGINT + 1)) AS copy FROM d""", ints="copy")
def weighted_draw(spark, sf_dir):
    """Rows repeated by weight, twice the table in expectation."""
    items = _items(spark, sf_dir)
    weights = balance.class_weights(balance.class_counts(items, "stratum"), "temperature", 0.3)
    drawn = balance.weighted_draw(items, "stratum", "item_id", balance.expected_copies(weights, "double"))
    return drawn.select("item_id", "stratum", "copy")


@query("balanced_epoch", """
WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT *, 1.0::DOUBLE / n / sum(1.0::DOUBLE / n) OVER () AS weight FROM c)
SELECT class, n, max(n) OVER () * count(*) OVER () * weight / sum(n * weight) OVER () AS copies_per_row FROM w
""", ints="n", doubles="copies_per_row")
def balanced_epoch(spark, sf_dir):
    """Expected copies per row for an epoch of largest class times classes."""
    weights = balance.class_weights(balance.class_counts(I.table(spark, sf_dir, "orders"), "o_orderstatus"), "inverse")
    return balance.expected_copies(weights).select("class", "n", "copies_per_row")


@query("transfer_batch", ITEMS + f""",
c AS (SELECT stratum AS class, count(*) AS n FROM items GROUP BY 1),
r AS (SELECT *, max(n) OVER () - n AS deficit, row_number() OVER (ORDER BY n DESC, class) AS rn FROM c),
need AS (SELECT class AS target, deficit, (SELECT class FROM r WHERE rn = 1) AS donor FROM r WHERE deficit > 0),
d AS (SELECT item_id, stratum, confidence, target, deficit,
             row_number() OVER (PARTITION BY target ORDER BY {I.h('item_id')}, item_id) AS rn
      FROM items JOIN need ON stratum = donor WHERE confidence >= 0.5)
SELECT item_id AS source_id, stratum AS original_class, target AS transferred_class, confidence AS original_confidence,
       item_id || '_to_' || lower(target) || '.jpg' AS augmented_file, true AS is_augmented FROM d WHERE rn <= deficit
""", doubles="original_confidence")
def transfer_batch(spark, sf_dir):
    """Confident donors of the largest class, as many as each class lacks."""
    return balance.transfer_batch(_items(spark, sf_dir), "stratum", "item_id", "confidence", _deficits(spark, sf_dir))


@query("other_class_pool", ITEMS + " SELECT stratum, count(*) AS n FROM items WHERE stratum <> 'Dark' GROUP BY ALL", ints="n")
def other_class_pool(spark, sf_dir):
    """All other classes as one pool: a filter, no union."""
    return _items(spark, sf_dir).where(F.col("stratum") != "Dark").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
