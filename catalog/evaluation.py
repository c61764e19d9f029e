"""Metrics per model and stratum, paired tests, bootstrap, AUC and ROC."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.operators import audit, inference, joins, metrics, roc
from evenhand.plans import report

KEYS = ["model", "stratum"]
STRATA = I.STRATA
AVERAGES = "accuracy macro_precision macro_recall macro_f1 weighted_f1 balanced_accuracy"


@query("confusion_cells", I.ORDERS_SQL + """
SELECT model, stratum, true_class, pred_class, count(*) AS n FROM predicted GROUP BY ALL""", ints="n")
def confusion_cells(spark, sf_dir):
    return metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS)


@query("confusion_matrix_dense", I.VECTORS_SQL + """,
frame AS (SELECT model, a.k AS true_class, b.k AS pred_class FROM models, (SELECT DISTINCT k FROM means) a,
          (SELECT DISTINCT k FROM means) b),
counts AS (SELECT model, true_class, pred_class, count(*) AS n FROM scored GROUP BY ALL)
SELECT model, true_class, pred_class, coalesce(n, 0) AS n FROM frame LEFT JOIN counts USING (model, true_class, pred_class)
""", ints="n")
def confusion_matrix_dense(spark, sf_dir):
    cells = metrics.confusion_cells(I.embedding_scores(spark, sf_dir), ["model"])
    return metrics.dense_cells(cells, ["model"], I.VECTOR_CLASSES)


@query("accuracy_by_stratum", I.CELLS_SQL + """
SELECT model, stratum, sum(n) AS n, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) AS correct,
       sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy
FROM cells GROUP BY ALL""", ints="n correct", doubles="accuracy")
def accuracy_by_stratum(spark, sf_dir):
    cells = metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS)
    return metrics.accuracy(metrics.with_overall(cells, "stratum", ["n"], STRATA), KEYS)


@query("class_report", I.CELLS_SQL + """
SELECT model, stratum, class, support, predicted, tp, precision, recall, f1 FROM scored
""", ints="support predicted tp", doubles="precision recall f1")
def class_report(spark, sf_dir):
    cells = metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS)
    scores = metrics.class_scores(metrics.with_overall(cells, "stratum", ["n"], STRATA), KEYS, I.ORDER_CLASSES)
    return scores.drop("group_n", "group_correct")


AVERAGE_SQL = """
SELECT model, stratum, n, accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
       avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
       avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, n - wrong AS correct
FROM scored JOIN (
  SELECT model, stratum, sum(n) AS n, sum(CASE WHEN true_class <> pred_class THEN n ELSE 0 END) AS wrong,
         sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy
  FROM cells GROUP BY ALL) USING (model, stratum)
GROUP BY model, stratum, n, wrong, accuracy"""


@query("stratified_metrics", I.CELLS_SQL + AVERAGE_SQL, ints="n correct", doubles=AVERAGES)
def stratified_metrics(spark, sf_dir):
    """All averages per (model, stratum) and overall, over a fixed label list."""
    return metrics.stratified_metrics(
        I.order_scores(spark, sf_dir), labels=I.ORDER_CLASSES, strata=STRATA)


@query("macro_f1_grid", I.CELLS_SQL + """,
f AS (SELECT model, stratum, avg(f1) AS macro_f1 FROM scored GROUP BY ALL)
SELECT model, max(macro_f1) FILTER (WHERE stratum = 'Light') AS Light,
       max(macro_f1) FILTER (WHERE stratum = 'Medium') AS Medium,
       max(macro_f1) FILTER (WHERE stratum = 'Dark') AS Dark,
       max(macro_f1) FILTER (WHERE stratum = 'Overall') AS Overall FROM f GROUP BY model
""", doubles="Light Medium Dark Overall")
def macro_f1_grid(spark, sf_dir):
    """Models x strata grid of macro F1."""
    scores = metrics.stratified_metrics(
        I.order_scores(spark, sf_dir), labels=I.ORDER_CLASSES, strata=STRATA)
    return metrics.pivot_grid(scores, "model", "stratum", "macro_f1", [*STRATA, "Overall"], rows=list(I.MODELS))


@query("macro_f1_seen_labels", I.VECTORS_SQL + """,
cells AS (SELECT model, stratum, true_class, pred_class, count(*) AS n FROM scored GROUP BY ALL),
per_class AS (
  SELECT model, stratum, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, stratum, true_class AS class, n AS support, 0 AS predicted,
           CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT model, stratum, pred_class, 0, n, 0 FROM cells) GROUP BY ALL)
SELECT model, stratum, sum(support) AS n, avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1,
       avg(tp::DOUBLE / support) FILTER (WHERE support > 0) AS balanced_accuracy
FROM per_class GROUP BY ALL""", ints="n", doubles="macro_f1 balanced_accuracy")
def macro_f1_seen_labels(spark, sf_dir):
    """Macro F1 over the labels seen in truth or prediction."""
    cells = metrics.confusion_cells(I.embedding_scores(spark, sf_dir), KEYS)
    return metrics.average_scores(metrics.class_scores(cells, KEYS), KEYS).select(
        *KEYS, "n", "macro_f1", "balanced_accuracy")


@query("partial_label_metrics", I.CELLS_SQL + """
SELECT model, stratum, sum(support) AS n, sum(CASE WHEN class IN ('F', 'O') THEN f1 END) / 3 AS macro_f1,
       sum(CASE WHEN class IN ('F', 'O') THEN f1 * support END) / sum(CASE WHEN class IN ('F', 'O') THEN support END) AS weighted_f1
FROM scored GROUP BY ALL""", ints="n", doubles="macro_f1 weighted_f1")
def partial_label_metrics(spark, sf_dir):
    """A label list without class P and with an absent class Z."""
    cells = metrics.with_overall(
        metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS), "stratum", ["n"], STRATA)
    return metrics.average_scores(metrics.class_scores(cells, KEYS, ["F", "O", "Z"]), KEYS).select(
        *KEYS, "n", "macro_f1", "weighted_f1")


@query("wide_class_scores", I.CELLS_SQL + """
SELECT model, stratum, """ + ", ".join(
    f"max({m}) FILTER (WHERE class = '{c}') AS {m}_{c}" for m in ("f1", "recall") for c in I.ORDER_CLASSES) + """
FROM scored GROUP BY ALL""", doubles="f1_F f1_O f1_P recall_F recall_O recall_P")
def wide_class_scores(spark, sf_dir):
    cells = metrics.with_overall(
        metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS), "stratum", ["n"], STRATA)
    return metrics.wide_class_scores(metrics.class_scores(cells, KEYS, I.ORDER_CLASSES), KEYS, I.ORDER_CLASSES)


@query("best_model_per_metric", I.CELLS_SQL + """,
a AS (""" + AVERAGE_SQL + """),
long AS (SELECT model, unnest(['accuracy', 'macro_f1', 'weighted_f1']) AS metric,
                unnest([accuracy, macro_f1, weighted_f1]) AS value FROM a WHERE stratum = 'Overall')
SELECT metric, arg_max(model, value) AS model, max(value) AS value FROM long GROUP BY metric""", doubles="value")
def best_model_per_metric(spark, sf_dir):
    scores = metrics.stratified_metrics(I.order_scores(spark, sf_dir), labels=I.ORDER_CLASSES, strata=STRATA)
    order = {m: i for i, m in enumerate(I.MODELS)}
    return metrics.best_model(
        scores.where(F.col("stratum") == "Overall"), ["accuracy", "macro_f1", "weighted_f1"], order)


# --- AUC and ROC -------------------------------------------------------------

ORDER_AUC_SQL = """,
long AS (SELECT model, stratum, true_class, unnest(['F', 'O', 'P']) AS class, unnest([p_F, p_O, p_P]) AS score FROM scores),
pos_neg AS (SELECT model, stratum, class, score, count(*) FILTER (WHERE class = true_class) AS pos,
                   count(*) FILTER (WHERE class <> true_class) AS neg FROM long GROUP BY ALL),
margin AS (SELECT * FROM pos_neg UNION ALL
           SELECT model, 'Overall', class, score, sum(pos), sum(neg) FROM pos_neg GROUP BY ALL),
below AS (SELECT *, sum(neg) OVER (PARTITION BY model, stratum, class ORDER BY score) - neg AS neg_below FROM margin),
auc AS (SELECT model, stratum, class, sum(pos) AS pos, sum(neg) AS neg,
               sum(pos::DOUBLE * (neg_below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc
        FROM below GROUP BY ALL)"""


@query("auc_by_class", I.ORDERS_SQL + ORDER_AUC_SQL + " SELECT * FROM auc", ints="pos neg", doubles="auc")
def auc_by_class(spark, sf_dir):
    """One-vs-rest AUC per (model, stratum, class) and overall, many tied scores."""
    return roc.stratified_auc(I.order_scores(spark, sf_dir), ["model"], "stratum", I.ORDER_CLASSES, STRATA)


@query("macro_auc_by_stratum", I.ORDERS_SQL + ORDER_AUC_SQL + """
SELECT model, stratum, avg(auc) AS macro_auc FROM auc GROUP BY ALL""", doubles="macro_auc")
def macro_auc_by_stratum(spark, sf_dir):
    cells = roc.stratified_auc(I.order_scores(spark, sf_dir), ["model"], "stratum", I.ORDER_CLASSES, STRATA)
    return roc.macro_auc(cells, KEYS)


VECTOR_AUC_SQL = """,
long AS (SELECT model, probs.k AS class, true_class, p AS score FROM probs JOIN items USING (item_id)),
pairs AS (SELECT a.model, a.class, count(*) AS n, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE
                 WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) AS u
          FROM long a JOIN long b ON a.model = b.model AND a.class = b.class
          WHERE a.true_class = a.class AND b.true_class <> b.class GROUP BY ALL),
auc AS (SELECT model, class, u / n AS auc FROM pairs)"""


@query("auc_continuous_scores", I.VECTORS_SQL + VECTOR_AUC_SQL + " SELECT model, class, auc FROM auc", doubles="auc")
def auc_continuous_scores(spark, sf_dir):
    """AUC on continuous scores against the pairwise definition."""
    cells = roc.score_cells(I.embedding_scores(spark, sf_dir), ["model"], I.VECTOR_CLASSES)
    return roc.auc_by_class(cells, ["model"]).select("model", "class", "auc")


@query("macro_auc_undefined_as_zero", I.VECTORS_SQL + VECTOR_AUC_SQL + """
SELECT model, avg(auc) AS macro_auc, 0.0::DOUBLE AS macro_auc_with_absent FROM auc GROUP BY model
""", doubles="macro_auc macro_auc_with_absent")
def macro_auc_undefined_as_zero(spark, sf_dir):
    """Macro AUC that turns 0 as soon as a listed class has no positives."""
    scores = I.embedding_scores(spark, sf_dir)
    full = roc.auc_by_class(roc.score_cells(scores, ["model"], I.VECTOR_CLASSES), ["model"])
    absent = full.select("model").distinct().withColumns({
        "class": F.lit("absent"), "pos": F.lit(0).cast("bigint"), "neg": F.lit(1).cast("bigint"),
        "auc": F.lit(None).cast("double")})
    wide = full.unionByName(absent)
    return roc.macro_auc(full, ["model"], "zero").join(
        roc.macro_auc(wide, ["model"], "zero").withColumnRenamed("macro_auc", "macro_auc_with_absent"), "model")


ROC_SQL = """,
long AS (SELECT model, true_class, unnest(['F', 'O', 'P']) AS class, unnest([p_F, p_O, p_P]) AS score FROM scores),
pn AS (SELECT model, class, score, count(*) FILTER (WHERE class = true_class) AS pos,
              count(*) FILTER (WHERE class <> true_class) AS neg FROM long GROUP BY ALL),
curve AS (SELECT model, class, score AS threshold,
       sum(pos) OVER w::DOUBLE / sum(pos) OVER g AS tpr, sum(neg) OVER w::DOUBLE / sum(neg) OVER g AS fpr, pos, neg,
       lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS rn
  FROM pn WINDOW w AS (PARTITION BY model, class ORDER BY score DESC), g AS (PARTITION BY model, class)),
start AS (SELECT DISTINCT model, class, NULL::DOUBLE AS threshold, 0.0::DOUBLE AS tpr, 0.0::DOUBLE AS fpr FROM pn)"""


@query("roc_points", I.ORDERS_SQL + ROC_SQL + """
SELECT * FROM start UNION ALL SELECT model, class, threshold, tpr, fpr FROM curve""", doubles="threshold tpr fpr")
def roc_points(spark, sf_dir):
    return roc.roc_points(roc.score_cells(I.order_scores(spark, sf_dir), ["model"], I.ORDER_CLASSES), ["model"])


@query("roc_turning_points", I.ORDERS_SQL + ROC_SQL + """
SELECT * FROM start UNION ALL SELECT model, class, threshold, tpr, fpr FROM curve
WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""", doubles="threshold tpr fpr")
def roc_turning_points(spark, sf_dir):
    """ROC points without those on a straight line."""
    cells = roc.score_cells(I.order_scores(spark, sf_dir), ["model"], I.ORDER_CLASSES)
    return roc.roc_points(cells, ["model"], drop_collinear=True)


# --- joins of the three tables -----------------------------------------------

@query("merge_three_tables", I.VECTORS_SQL + """
SELECT model, item_id, stratum, confidence, true_class, pred_class FROM scored WHERE confidence >= 0.6 AND NOT flag
""", doubles="confidence")
def merge_three_tables(spark, sf_dir):
    """Strata x truth x predictions with a confidence threshold and without flagged items."""
    items = I.embedding_items(spark, sf_dir)
    predictions = I.embedding_scores(spark, sf_dir).select("model", "item_id", "pred_class")
    return joins.build_merged(
        items.select("item_id", "stratum", "confidence", "flag"), items.select("item_id", "true_class"), predictions,
        "item_id", 0.6, exclude_flag="flag",
    ).select("model", "item_id", "stratum", "confidence", "true_class", "pred_class")


@query("manifest_accuracy", I.ORDERS_SQL + """
SELECT model, stratum, count(*) AS n, avg(CASE WHEN pred_class = true_class THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
FROM predicted GROUP BY ALL""", ints="n", doubles="accuracy")
def manifest_accuracy(spark, sf_dir):
    """Manifest joined with the predictions of all models: quick accuracy."""
    manifest = I.order_items(spark, sf_dir)
    predictions = I.order_scores(spark, sf_dir).select("item_id", "model", "pred_class")
    merged = manifest.select("item_id", "true_class", "stratum").join(predictions, "item_id")
    return metrics.accuracy(metrics.confusion_cells(merged, KEYS), KEYS).select(*KEYS, "n", "accuracy")


PAIRED_SQL = I.ORDERS_SQL + """,
paired AS (SELECT item_id, any_value(stratum) AS stratum, """ + ", ".join(
    f"bool_or(pred_class = true_class) FILTER (WHERE model = '{m}') AS {m}" for m in I.MODELS) + """
  FROM predicted GROUP BY item_id)"""


@query("paired_correctness", PAIRED_SQL + """
SELECT stratum, orig, lambda10, count(*) AS n FROM paired GROUP BY ALL""", ints="n")
def paired_correctness(spark, sf_dir):
    """Each item once with the outcome of every model, without self-joins."""
    paired = inference.paired_correct(I.order_scores(spark, sf_dir), "item_id", list(I.MODELS), ["stratum"])
    return paired.groupBy("stratum", "orig", "lambda10").agg(F.count(F.lit(1)).alias("n"))


MCNEMAR_SQL = PAIRED_SQL + """,
long AS (SELECT stratum, orig AS a, unnest(['lambda00', 'lambda03', 'lambda07', 'lambda10']) AS other,
                unnest([lambda00, lambda03, lambda07, lambda10]) AS b FROM paired),
cells AS (SELECT stratum, other, a, b, count(*) AS n FROM long GROUP BY ALL),
margin AS (SELECT * FROM cells UNION ALL SELECT 'Overall', other, a, b, sum(n) FROM cells GROUP BY ALL),
counts AS (SELECT 'orig' AS baseline, other, stratum, sum(n) AS n,
  coalesce(sum(n) FILTER (WHERE a AND b), 0) AS both_correct,
  coalesce(sum(n) FILTER (WHERE a AND NOT b), 0) AS only_baseline_correct,
  coalesce(sum(n) FILTER (WHERE NOT a AND b), 0) AS only_other_correct,
  coalesce(sum(n) FILTER (WHERE NOT a AND NOT b), 0) AS neither_correct FROM margin GROUP BY other, stratum)"""
COUNTS = "n both_correct only_baseline_correct only_other_correct neither_correct"


def _mcnemar(spark, sf_dir):
    others = [m for m in I.MODELS if m != "orig"]
    paired = inference.paired_correct(I.order_scores(spark, sf_dir), "item_id", list(I.MODELS), ["stratum"])
    return inference.mcnemar_counts(paired, "orig", others, "stratum", STRATA)


@query("mcnemar_counts", MCNEMAR_SQL + """
SELECT *, CASE WHEN only_baseline_correct + only_other_correct = 0 THEN 0
     WHEN only_baseline_correct + only_other_correct < 25 THEN least(only_baseline_correct, only_other_correct)
     ELSE pow(abs(only_baseline_correct - only_other_correct) - 1, 2) / (only_baseline_correct + only_other_correct) END AS statistic
FROM counts""", ints=COUNTS, doubles="statistic")
def mcnemar_counts(spark, sf_dir):
    """Paired counts and statistic of each model against the baseline."""
    return inference.mcnemar_test(_mcnemar(spark, sf_dir)).drop("p_value")


@query("mcnemar_significance", MCNEMAR_SQL + """
SELECT other, stratum, CASE WHEN chi >= 10.8276 THEN '***' WHEN chi >= 6.6349 THEN '**' WHEN chi >= 3.8415 THEN '*'
       ELSE 'ns' END AS stars
FROM (SELECT *, pow(abs(only_baseline_correct - only_other_correct) - 1, 2) / (only_baseline_correct + only_other_correct) AS chi
      FROM counts)""")
def mcnemar_significance(spark, sf_dir):
    """p-value as stars; the SQL compares the statistic with the chi-square quantiles."""
    from evenhand.functions.labels import significance_stars

    tested = inference.mcnemar_test(_mcnemar(spark, sf_dir), exact_below=0)
    return tested.select("other", "stratum", significance_stars(F.col("p_value")).alias("stars"))


# --- uncertainty -------------------------------------------------------------

def bootstrap_sql(with_cells: str, keys: list[str], classes: list[str], draws: int = 1000, frame: str = "") -> str:
    """Intervals from the CTE ``cells`` (keys, true_class, pred_class, n): one binomial for each draw and cell, cell by cell."""
    listed = ", ".join(keys)
    word = lambda start, attempt: (
        f"(CAST('0x' || substr(md5(concat_ws('|', '42', g, d, i, {attempt})), {start}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE")
    half = f"({word(1, 't')} - 0.5::DOUBLE)"
    edge = f"(0.5::DOUBLE - abs({half}))"
    return with_cells.replace("WITH", "WITH RECURSIVE", 1) + f""",
numbered AS (
  SELECT {listed}, true_class, pred_class, CAST(n AS BIGINT) AS n, {I.h("'bootstrap'", *keys)} AS g,
         row_number() OVER (PARTITION BY {listed} ORDER BY true_class, pred_class NULLS LAST) AS i,
         CAST(sum(n) OVER (PARTITION BY {listed} ORDER BY true_class, pred_class NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM cells WHERE n > 0),
walk AS (
  SELECT g, d, CAST(0 AS BIGINT) AS i, rest AS m, CAST(0 AS BIGINT) AS x FROM numbered, range({draws}) AS t(d) WHERE i = 1
  UNION ALL
  SELECT g, d, i, m - x, x FROM (
    SELECT g, d, i, m, CASE WHEN q >= 1 THEN m WHEN q > 0.5 THEN m - x0 ELSE x0 END AS x FROM (
      SELECT *, CAST(CASE
        WHEN q >= 1 THEN m
        WHEN m * p < 10 THEN len(list_filter(range(1, len(masses) + 1), lambda j: list_sum(list_slice(masses, 1, j)) < u))
        ELSE list_filter(list_transform(range(40), lambda t: CASE
          WHEN {edge} >= 0.07 AND {word(9, 't')} <= 0.92 - 4.2 / b THEN floor((2 * a / {edge} + b) * {half} + m * p + 0.5)
          WHEN floor((2 * a / {edge} + b) * {half} + m * p + 0.5) NOT BETWEEN 0 AND m THEN NULL
          WHEN ln({word(9, 't')} * (2.83 + 5.1 / b) * s / (a / ({edge} * {edge}) + b))
               <= lgamma(mode + 1) + lgamma(m - mode + 1) - lgamma(floor((2 * a / {edge} + b) * {half} + m * p + 0.5) + 1)
                  - lgamma(m - floor((2 * a / {edge} + b) * {half} + m * p + 0.5) + 1)
                  + (floor((2 * a / {edge} + b) * {half} + m * p + 0.5) - mode) * ln(p / (1 - p))
          THEN floor((2 * a / {edge} + b) * {half} + m * p + 0.5) END), lambda k: k IS NOT NULL)[1] END AS BIGINT) AS x0
      FROM (
        SELECT *, floor((m + 1) * p) AS mode, -0.0873 + 0.0248 * b + 0.01 * p AS a,
               CASE WHEN m * p < 10 THEN {word(1, '0')} END AS u,
               CASE WHEN q < 1 AND m * p < 10 THEN list_transform(
                 range(0, CAST(least(m, ceil(m * p + 6 * sqrt(m * p) + 8)) AS BIGINT) + 1),
                 lambda k: exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p))) END AS masses
        FROM (
          SELECT *, 1.15::DOUBLE + 2.53::DOUBLE * s AS b FROM (
            SELECT *, sqrt(m * p * (1 - p)) AS s FROM (
              SELECT w.g, w.d, c.i, CAST(w.m AS DOUBLE) AS m, c.n::DOUBLE / c.rest AS q,
                     least(c.n::DOUBLE / c.rest, 1 - c.n::DOUBLE / c.rest) AS p
              FROM walk w JOIN numbered c ON c.g = w.g AND c.i = w.i + 1))))))),
resampled AS (
  SELECT {listed}, d, true_class, pred_class, x AS k FROM walk JOIN numbered USING (g, i)
  UNION ALL SELECT {listed}, -1, true_class, pred_class, n FROM numbered),
sides AS (
  SELECT {listed}, d, class, sum(s) AS s, sum(h) AS h FROM (
    SELECT {listed}, d, true_class AS class, k AS s, CASE WHEN true_class = pred_class THEN k ELSE 0 END AS h FROM resampled
    UNION ALL SELECT {listed}, d, pred_class, k, 0 FROM resampled) GROUP BY ALL),
f1 AS (
  SELECT {listed}, d, sum(CASE WHEN s > 0 THEN 2.0::DOUBLE * h / s ELSE 0 END) / {len(classes)} AS f
  FROM sides WHERE class IN ({", ".join(repr(c) for c in classes)}) GROUP BY ALL)
SELECT {listed}, coalesce(any_value(size), 0) AS n, max(f) FILTER (WHERE d < 0) AS macro_f1,
       quantile_cont(f, 0.025) FILTER (WHERE d >= 0) AS ci_low, quantile_cont(f, 0.975) FILTER (WHERE d >= 0) AS ci_high
FROM f1 JOIN (SELECT {listed}, sum(n) AS size FROM numbered GROUP BY ALL) USING ({listed}) GROUP BY {listed}"""


@query("bootstrap_intervals", bootstrap_sql(I.CELLS_SQL, KEYS, I.ORDER_CLASSES), ints="n", doubles="macro_f1 ci_low ci_high")
def bootstrap_intervals(spark, sf_dir):
    """95 % bootstrap interval of macro F1 per (model, stratum) and overall, 1,000 draws."""
    cells = metrics.with_overall(
        metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS), "stratum", ["n"], STRATA)
    return inference.bootstrap_macro_f1(cells, KEYS, I.ORDER_CLASSES, strata=STRATA)


@query("bootstrap_point_estimates", I.CELLS_SQL + """
SELECT model, stratum, any_value(n) AS n, avg(f1) AS macro_f1, true AS covered FROM scored
JOIN (SELECT model, stratum, sum(n) AS n FROM cells GROUP BY ALL) USING (model, stratum) GROUP BY model, stratum
""", ints="n", doubles="macro_f1")
def bootstrap_point_estimates(spark, sf_dir):
    """Point estimates of the bootstrap job, and that each interval holds its point."""
    cells = metrics.with_overall(
        metrics.confusion_cells(I.order_scores(spark, sf_dir), KEYS), "stratum", ["n"], STRATA)
    ci = inference.bootstrap_macro_f1(cells, KEYS, I.ORDER_CLASSES, strata=STRATA)
    return ci.select(*KEYS, "n", "macro_f1", F.col("macro_f1").between(F.col("ci_low"), F.col("ci_high")).alias("covered"))


DRAWS = 20
_weights = ", ".join(
    "sum(CASE " + " ".join(
        f"WHEN x{d} < {bound!r} THEN {count}" for count, bound in enumerate(inference.POISSON_ONE_CDF)
    ) + f" ELSE {len(inference.POISSON_ONE_CDF)} END) AS w{d}" for d in range(DRAWS))
POISSON_SQL = I.ORDERS_SQL + f""",
draws AS (SELECT model, stratum, true_class, pred_class,
  {', '.join(f"{I.u(repr(f'draw{d // 4}'), 'item_id', word=d % 4)} AS x{d}" for d in range(DRAWS))} FROM predicted),
weighted AS (SELECT model, stratum, true_class, pred_class, {_weights} FROM draws GROUP BY ALL),
cells AS (SELECT model, stratum, true_class, pred_class, unnest(range({DRAWS})) AS draw,
                 unnest([{', '.join(f'w{d}' for d in range(DRAWS))}]) AS n FROM weighted),
per_class AS (
  SELECT model, stratum, draw, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, stratum, draw, true_class AS class, n AS support, 0 AS predicted,
           CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT model, stratum, draw, pred_class, 0, n, 0 FROM cells) GROUP BY ALL),
f1 AS (SELECT model, stratum, draw, sum(support) AS n, avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1
       FROM per_class GROUP BY ALL)"""


@query("poisson_bootstrap_draws", POISSON_SQL + " SELECT * FROM f1", ints="draw n", doubles="macro_f1")
def poisson_bootstrap_draws(spark, sf_dir):
    """Row-level bootstrap with hashed Poisson weights: one macro F1 per draw."""
    return inference.poisson_bootstrap_f1(I.order_scores(spark, sf_dir), KEYS, "item_id", DRAWS, I.ORDER_CLASSES)


@query("poisson_bootstrap_interval", POISSON_SQL + """
SELECT model, stratum, quantile_cont(macro_f1, 0.025) AS ci_low, quantile_cont(macro_f1, 0.975) AS ci_high
FROM f1 GROUP BY ALL""", doubles="ci_low ci_high")
def poisson_bootstrap_interval(spark, sf_dir):
    draws = inference.poisson_bootstrap_f1(I.order_scores(spark, sf_dir), KEYS, "item_id", DRAWS, I.ORDER_CLASSES)
    return inference.poisson_interval(draws, KEYS)


STRICTER_SQL = I.VECTORS_SQL + """,
tagged AS (SELECT t AS threshold, scored.* FROM scored JOIN (VALUES (0.6::DOUBLE), (0.8::DOUBLE)) v(t) ON confidence >= t),
base AS (SELECT threshold, model, stratum, true_class, pred_class, count(*) AS n FROM tagged GROUP BY ALL),
cells AS (SELECT * FROM base UNION ALL SELECT threshold, model, 'Overall', true_class, pred_class, sum(n) FROM base GROUP BY ALL)"""


@query("sensitivity_metrics", STRICTER_SQL + """,
per_class AS (
  SELECT threshold, model, stratum, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT threshold, model, stratum, true_class AS class, n AS support, 0 AS predicted,
           CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT threshold, model, stratum, pred_class, 0, n, 0 FROM cells) GROUP BY ALL)
SELECT threshold, model, stratum, sum(support) AS n, sum(2.0::DOUBLE * tp / (support + predicted)) / 10 AS macro_f1
FROM per_class GROUP BY ALL""", ints="n", doubles="threshold macro_f1")
def sensitivity_metrics(spark, sf_dir):
    """Metrics at two confidence thresholds in one job."""
    cells = inference.sensitivity_cells(
        I.embedding_scores(spark, sf_dir), "confidence", [0.6, 0.8], ["model"], "stratum", STRATA)
    keys = ["threshold", *KEYS]
    return metrics.average_scores(metrics.class_scores(cells, keys, I.VECTOR_CLASSES), keys).select(
        *keys, "n", "macro_f1")


@query("sensitivity_intervals", bootstrap_sql(STRICTER_SQL, ["threshold", *KEYS], I.VECTOR_CLASSES), ints="n",
       doubles="threshold macro_f1 ci_low ci_high")
def sensitivity_intervals(spark, sf_dir):
    """Bootstrap intervals on the stricter subsets."""
    cells = inference.sensitivity_cells(
        I.embedding_scores(spark, sf_dir), "confidence", [0.6, 0.8], ["model"], "stratum", STRATA)
    return inference.bootstrap_macro_f1(cells, ["threshold", *KEYS], I.VECTOR_CLASSES)


@query("rater_agreement_metrics", I.ORDERS_SQL + """,
base AS (SELECT model, stratum, true_class, pred_class, count(*) AS n FROM predicted WHERE r1 = r2 GROUP BY ALL),
per_class AS (
  SELECT model, stratum, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, stratum, true_class AS class, n AS support, 0 AS predicted,
           CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM base
    UNION ALL SELECT model, stratum, pred_class, 0, n, 0 FROM base) GROUP BY ALL)
SELECT model, stratum, sum(support) AS n, avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1
FROM per_class GROUP BY ALL""", ints="n", doubles="macro_f1")
def rater_agreement_metrics(spark, sf_dir):
    """Metrics on the rows where both raters are present and agree."""
    rows = I.order_scores(spark, sf_dir)
    agreed = rows.where(F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("r1") == F.col("r2")))
    cells = metrics.confusion_cells(agreed, KEYS)
    return metrics.average_scores(metrics.class_scores(cells, KEYS, I.ORDER_CLASSES), KEYS).select(
        *KEYS, "n", "macro_f1")


_f1 = ", ".join(f"max(CASE WHEN class = '{c}' THEN 2.0::DOUBLE * tp / (support + predicted) END) AS f1_{c}" for c in I.VECTOR_CLASSES)
_auc = ", ".join(f"max(CASE WHEN class = '{c}' THEN auc END) AS auc_{c}" for c in I.VECTOR_CLASSES)
_each = " ".join(f"f1_{c} auc_{c}" for c in I.VECTOR_CLASSES)
REPORT_SQL = I.VECTORS_SQL + VECTOR_AUC_SQL + f""",
per_class AS (
  SELECT model, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, true_class AS class, 1 AS support, 0 AS predicted, (true_class = pred_class)::INT AS tp FROM scored
    UNION ALL SELECT model, pred_class, 0, 1, 0 FROM scored) GROUP BY ALL),
averages AS (SELECT model, sum(support) AS n, sum(tp)::DOUBLE / sum(support) AS accuracy,
    avg(CASE WHEN support > 0 THEN tp::DOUBLE / support END) AS balanced_accuracy,
    avg(CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END) AS macro_precision,
    avg(CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END) AS macro_recall,
    avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1,
    sum(2.0::DOUBLE * tp / (support + predicted) * support) / sum(support) AS weighted_f1, {_f1} FROM per_class GROUP BY model),
conf AS (SELECT model, avg(score) AS mean_conf, avg(score) FILTER (WHERE true_class = pred_class) AS correct_conf,
    avg(score) FILTER (WHERE true_class <> pred_class) AS incorrect_conf FROM scored GROUP BY model),
report AS (
  SELECT * FROM averages JOIN (SELECT model, avg(auc) AS macro_auc, {_auc} FROM auc GROUP BY model) USING (model) JOIN conf USING (model))"""


@query("combined_model_report", REPORT_SQL + " SELECT * FROM report", ints="n", doubles="accuracy balanced_accuracy macro_precision "
       "macro_recall macro_f1 weighted_f1 macro_auc mean_conf correct_conf incorrect_conf " + _each)
def combined_model_report(spark, sf_dir):
    """One row per model: averages, F1 and AUC of every class, confidence."""
    return report.combined_report(I.embedding_scores(spark, sf_dir), I.VECTOR_CLASSES)


_metrics = " UNION ALL ".join(f"SELECT '{m}' AS metric, model, {m} AS value FROM report" for m in report.BEST_BY)


@query("best_models", REPORT_SQL + f"""
SELECT metric, min(model) AS model, any_value(value) AS value FROM ({_metrics}) m
JOIN (SELECT metric, max(value) AS value FROM ({_metrics}) n GROUP BY metric) t USING (metric, value) GROUP BY metric""", doubles="value")
def best_models(spark, sf_dir):
    """The best model for each of five metrics."""
    return report.best_models(report.combined_report(I.embedding_scores(spark, sf_dir), I.VECTOR_CLASSES))
