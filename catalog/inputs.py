"""Input tables of the queries, derived from the test tables, with the same SQL text.

Orders play scored items of five models (``order_scores``), embeddings play a real
scorer (``embedding_scores``), documents play gate records, conversations play
candidate texts, pages play URLs and file names, events play measured values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.functions.hashing import uniform
from evenhand.functions.labels import predicted_class, softmax
from evenhand.functions.text import Lexicon
from evenhand.operators.scoring import class_means, nearest_mean_scores

MODELS = {"orig": 0.60, "lambda00": 0.64, "lambda03": 0.68, "lambda07": 0.72, "lambda10": 0.76}
MODEL_DIMS = {"orig": 8, "lambda00": 16, "lambda03": 32, "lambda07": 48, "lambda10": 64}
ORDER_CLASSES = ["F", "O", "P"]
VECTOR_CLASSES = [f"c{k}" for k in range(10)]
STRATA = ["Light", "Medium", "Dark"]
REGIONS = ["upper", "lower", "left", "right", "center", "upper-left"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(*parts: str, word: int = 0) -> str:
    """SQL text of ``uniform`` (and of word ``word`` of ``uniform_slices``); parts are SQL expressions."""
    key = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '42', {key})), {1 + 8 * word}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def h(*parts: str) -> str:
    """SQL text of ``hash32``."""
    key = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', {key})), 1, 8) AS BIGINT)"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_case(value: str, mapping: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {value} = {k!r} THEN {v!r}" for k, v in mapping.items())
    return f"CASE {arms} ELSE {otherwise} END"


# --- orders as scored items --------------------------------------------------

PRIORITY_STRATUM = {"1-URGENT": "Light", "2-HIGH": "Light", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Medium",
                    "5-LOW": "Dark"}


def order_items(spark: SparkSession, sf_dir: str, source: bool = False) -> DataFrame:
    """(item_id, true_class, stratum, r1, r2[, source]), one row per order."""
    from evenhand.functions.labels import map_values

    orders = table(spark, sf_dir, "orders")
    item = F.col("o_orderkey").cast("string")
    r1 = F.lit(1) + F.col("o_orderkey") % 6
    columns = [
        item.alias("item_id"), F.col("o_orderstatus").alias("true_class"),
        map_values(F.col("o_orderpriority"), PRIORITY_STRATUM).alias("stratum"), r1.alias("r1"),
        F.when(uniform("r2", item) < 0.2, F.lit(1) + r1 % 6).otherwise(r1).alias("r2"),
    ]
    if source:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
            nations, F.col("c_nationkey") == F.col("n_nationkey"))
        columns.append(F.col("n_name").alias("source"))
    return orders.select(*columns)


def order_predictions(items: DataFrame) -> DataFrame:
    """Five models' predictions and class scores of the items, long form."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("acc")) for m, a in MODELS.items()])
    rows = items.select("*", F.inline(models))
    following = F.when(F.col("true_class") == "F", "O").when(F.col("true_class") == "O", "P").otherwise("F")
    right = uniform(F.col("model"), F.col("item_id")) < F.col("acc")
    rows = rows.withColumn("pred_class", F.when(right, F.col("true_class")).otherwise(following))

    def score(c: str) -> Column:
        bonus = F.when(F.col("pred_class") == c, 1).otherwise(0)
        return F.round((uniform(F.col("model"), F.lit(c), F.col("item_id")) + bonus) / 2, 2)

    return rows.withColumn("probs", F.array(*[score(c) for c in ORDER_CLASSES])).drop("acc")


def order_scores(spark: SparkSession, sf_dir: str, source: bool = False) -> DataFrame:
    return order_predictions(order_items(spark, sf_dir, source))


def _order_sql() -> str:
    models = ", ".join(f"('{m}', {a}::DOUBLE)" for m, a in MODELS.items())
    scores = ", ".join(
        f"round(({u('model', repr(c), 'item_id')} + CASE WHEN pred_class = '{c}' THEN 1 ELSE 0 END) / 2, 2) AS p_{c}"
        for c in ORDER_CLASSES)
    return f"""
items AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderstatus AS true_class,
         {sql_case('o_orderpriority', PRIORITY_STRATUM)} AS stratum, 1 + o_orderkey % 6 AS r1,
         CASE WHEN {u("'r2'", 'o_orderkey')} < 0.2 THEN 1 + (1 + o_orderkey % 6) % 6 ELSE 1 + o_orderkey % 6 END AS r2,
         n_name AS source
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
models(model, acc) AS (VALUES {models}),
predicted AS (
  SELECT items.*, model,
         CASE WHEN {u('model', 'item_id')} < acc THEN true_class
              WHEN true_class = 'F' THEN 'O' WHEN true_class = 'O' THEN 'P' ELSE 'F' END AS pred_class
  FROM items CROSS JOIN models),
scores AS (SELECT *, {scores} FROM predicted)"""


ORDERS_SQL = "WITH" + _order_sql()

# Per-stratum rows plus the overall margin, as one CTE after ORDERS_SQL.
CELLS_SQL = ORDERS_SQL + """,
base AS (SELECT model, stratum, true_class, pred_class, count(*) AS n FROM predicted GROUP BY ALL),
cells AS (SELECT * FROM base UNION ALL
          SELECT model, 'Overall', true_class, pred_class, sum(n) FROM base GROUP BY ALL),
per_class AS (
  SELECT model, stratum, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, stratum, true_class AS class, n AS support, 0 AS predicted,
           CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT model, stratum, pred_class, 0, n, 0 FROM cells) GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1
  FROM per_class)"""


# --- embeddings with a nearest-mean scorer -----------------------------------

def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, true_class, stratum, confidence, method, flag, embedding)."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("item_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("true_class"),
        F.when(v % 10 <= 5, "Light").when(v % 10 <= 8, "Medium").otherwise("Dark").alias("stratum"),
        uniform("conf", v).alias("confidence"),
        F.when(v % 3 == 0, "ring").when(v % 3 == 1, "patch").otherwise("full").alias("method"),
        (v % 7 == 0).alias("flag"), "embedding",
    )


def embedding_scores(
    spark: SparkSession, sf_dir: str, dims: dict[str, int] | None = None
) -> DataFrame:
    """Items x models with probs, pred_class and score (largest probability)."""
    items = embedding_items(spark, sf_dir)
    means = class_means(items, "true_class", "embedding", 64)
    carry = [c for c in items.columns if c != "embedding"]
    scored = nearest_mean_scores(items, means, "embedding", dims or MODEL_DIMS, carry)
    probs = scored.withColumn("probs", softmax(F.col("scores")))
    return probs.withColumns({
        "pred_class": predicted_class(F.col("scores"), VECTOR_CLASSES), "score": F.array_max("probs")})


ITEMS_SQL = f"""
items AS (
  SELECT vec_id AS item_id, 'c' || label AS true_class,
         CASE WHEN vec_id % 10 <= 5 THEN 'Light' WHEN vec_id % 10 <= 8 THEN 'Medium' ELSE 'Dark' END AS stratum,
         {u("'conf'", 'vec_id')} AS confidence,
         CASE vec_id % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'patch' ELSE 'full' END AS method,
         vec_id % 7 = 0 AS flag, embedding
  FROM embeddings)"""

_dims = ", ".join(f"('{m}', {d})" for m, d in MODEL_DIMS.items())
VECTORS_SQL = f"""WITH{ITEMS_SQL},
dims AS (SELECT item_id, true_class, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d
         FROM items),
means AS (SELECT true_class AS k, d, avg(v) AS m FROM dims GROUP BY 1, 2),
gaps AS (SELECT item_id, k, dims.d, (v - m) * (v - m) AS g FROM dims JOIN means ON dims.d = means.d),
models(model, nd) AS (VALUES {_dims}),
dist AS (SELECT model, item_id, k, -sum(g) AS s FROM gaps JOIN models ON d <= nd GROUP BY ALL),
soft AS (SELECT model, item_id, k, s, exp(s - max(s) OVER w) AS e FROM dist WINDOW w AS (PARTITION BY model, item_id)),
probs AS (SELECT model, item_id, k, s, e / sum(e) OVER (PARTITION BY model, item_id) AS p FROM soft),
best AS (SELECT model, item_id, arg_max(k, s) AS pred_class, max(p) AS score FROM probs GROUP BY ALL),
scored AS (SELECT items.* EXCLUDE (embedding), model, pred_class, score FROM best JOIN items USING (item_id))"""


# --- documents and conversations as texts ------------------------------------

LEXICON = Lexicon(
    keywords={
        "en": ["the", "and", "that", "with", "from"], "fr": ["des", "les", "pour", "dans"],
        "de": ["der", "und", "nicht", "von"], "es": ["que", "los", "para", "con"],
    },
    default_keywords=("lesion", "skin"), min_keywords=3, reject=("license", "token"),
    regions={"upper": ["thon"], "lower": ["ther"], "left": ["ble"], "right": ["ing"], "center": ["and"]},
    hedges=("the ", "und ", "que ", "des "), definitive=("apache",), min_words=60, max_words=200,
)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gate records."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.col("text").alias("teacher_reasoning"),
        F.col("lang").alias("predicted_class"),
        F.get(F.array(*[F.lit(r) for r in REGIONS]), (F.col("doc_id") % 6).cast("int")).alias("gradcam_spatial_region"),
        "source",
    )


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as candidate answers of an item."""
    langs = F.array(*[F.lit(x) for x in LEXICON.keywords])
    turns = table(spark, sf_dir, "conversations")
    return turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("teacher_reasoning"),
        F.get(langs, (F.col("conv_id") % 4).cast("int")).alias("predicted_class"),
        F.get(F.array(*[F.lit(r) for r in REGIONS]), (F.col("conv_id") % 6).cast("int")).alias("gradcam_spatial_region"),
    )


def _text_checks(base: str) -> str:
    """CTE ``checked`` over ``base(…, text, label, focus)``."""
    lex = LEXICON
    keywords = " ".join(
        f"WHEN '{c}' THEN list_filter({sql_list(t)}, lambda x: contains(low, x))" for c, t in lex.keywords.items())
    reject = "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{p}') THEN '{p}' END" for p in lex.reject) + ")"
    named = {r: " OR ".join(f"contains(low, '{t}')" for t in terms) for r, terms in lex.regions.items()}
    pairs = [("upper", "lower"), ("lower", "upper"), ("left", "right"), ("right", "left")]
    clash = ", ".join(
        f"CASE WHEN ({named[r]}) AND list_contains(parts, '{o}') AND NOT list_contains(parts, '{r}') THEN '{r}' END"
        for r, o in pairs)
    hedge = " OR ".join(f"contains(low, '{p}')" for p in lex.hedges)
    definitive = " OR ".join(f"contains(low, '{p}')" for p in lex.definitive)
    return f"""
prepared AS (SELECT *, lower(text) AS low, string_split(focus, '-') AS parts FROM {base}),
measured AS (
  SELECT *, CASE label {keywords} ELSE list_filter({sql_list(lex.default_keywords)}, lambda x: contains(low, x)) END AS matched,
         {reject} AS phrase,
         list_filter([{clash}], lambda x: x IS NOT NULL) AS conflicts,
         len(regexp_extract_all(text, '\\S+')) AS word_count,
         CASE WHEN {definitive} THEN 'contains definitive diagnostic language'
              WHEN NOT ({hedge}) THEN 'missing hedging/safety language' END AS problem
  FROM prepared),
checked AS (
  SELECT *, len(matched) >= {lex.min_keywords} AS pass_keywords, phrase IS NULL AS pass_indeterminate,
         len(conflicts) = 0 AS pass_spatial, word_count BETWEEN {lex.min_words} AND {lex.max_words} AS pass_length,
         problem IS NULL AS pass_safety
  FROM measured),
gated AS (
  SELECT *, CASE WHEN NOT pass_keywords THEN 'keyword_fail' WHEN NOT pass_indeterminate THEN 'indeterminate'
                 WHEN NOT pass_spatial THEN 'spatial_misalign' WHEN NOT pass_length THEN 'length_fail'
                 WHEN NOT pass_safety THEN 'safety_fail' END AS reason,
         pass_keywords AND pass_indeterminate AND pass_spatial AND pass_length AND pass_safety AS passed,
         pass_keywords::INT + pass_indeterminate::INT + pass_spatial::INT + pass_length::INT + pass_safety::INT AS n_passed,
         (CASE WHEN pass_keywords THEN 30 ELSE 0 END + CASE WHEN pass_indeterminate THEN 10 ELSE 0 END
          + CASE WHEN pass_spatial THEN 25 ELSE 0 END + CASE WHEN pass_length THEN 10 ELSE 0 END
          + CASE WHEN pass_safety THEN 25 ELSE 0 END) AS points
  FROM checked)"""


_regions = sql_list(REGIONS)
DOCUMENTS_SQL = f"""WITH records AS (
  SELECT doc_id AS image_id, text, lang AS label, {_regions}[doc_id % 6 + 1] AS focus, source FROM documents),
{_text_checks('records')}"""

CANDIDATES_SQL = f"""WITH records AS (
  SELECT conv_id, turn, text, {sql_list(LEXICON.keywords)}[conv_id % 4 + 1] AS label,
         {_regions}[conv_id % 6 + 1] AS focus
  FROM conversations WHERE role = 'assistant'),
{_text_checks('records')}"""


# --- embeddings as 8 x 8 arrays ----------------------------------------------

def arrays_8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, label, cells): 64 values in row-major order."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("cells"))


ARRAYS_SQL = """WITH arrays AS (
  SELECT vec_id AS item_id, 'c' || label AS label, embedding::DOUBLE[] AS cells FROM embeddings),
cells AS (SELECT item_id, label, unnest(cells) AS v, generate_subscripts(cells, 1) - 1 AS i FROM arrays)"""
