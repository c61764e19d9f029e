"""Label, scale and identifier expressions; joins and unions on keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions import labels as L
from evenhand.functions.hashing import uniform
from evenhand.operators import joins
from evenhand.sources.images import missing_paths, resolve_paths

CLASSES = I.VECTOR_CLASSES


def _one_hot(spark, sf_dir):
    """One-hot truth with ties and an unknown column, derived from the vectors."""
    items = I.table(spark, sf_dir, "embeddings")
    wide = L.one_hot(F.concat(F.lit("c"), F.col("label").cast("string")), CLASSES)
    wide["c9"] = F.when(F.col("vec_id") % 5 == 0, F.lit(1.0)).otherwise(wide["c9"])
    return items.select(
        F.col("vec_id").alias("image_id"), *[c.cast("double").alias(n) for n, c in wide.items()],
        F.when(F.col("vec_id") % 11 == 0, 1.0).otherwise(0.0).alias("UNK"))


@query("one_hot_to_label", """
SELECT vec_id AS image_id, 'c' || label AS true_class FROM embeddings WHERE vec_id % 11 <> 0""")
def one_hot_to_label(spark, sf_dir):
    """First maximum wins (every fifth row has a second one); unknown rows are dropped."""
    return joins.label_ground_truth(_one_hot(spark, sf_dir), CLASSES)


@query("one_hot_with_unknown", """
SELECT CASE WHEN vec_id % 11 = 0 THEN 'UNK' ELSE 'c' || label END AS true_class, count(*) AS n
FROM embeddings GROUP BY ALL""", ints="n")
def one_hot_with_unknown(spark, sf_dir):
    """Unknown rows kept as a class of their own."""
    rows = joins.label_ground_truth(_one_hot(spark, sf_dir), CLASSES, include_unknown=True)
    return rows.groupBy("true_class").agg(F.count(F.lit(1)).alias("n"))


@query("label_to_one_hot", """
SELECT o_orderkey AS item_id, (o_orderstatus = 'F')::INT AS is_F, (o_orderstatus = 'O')::INT AS is_O,
       (o_orderstatus = 'P')::INT AS is_P FROM orders""", doubles="is_F is_O is_P")
def label_to_one_hot(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")
    wide = L.one_hot(F.col("o_orderstatus"), I.ORDER_CLASSES, "is_")
    return orders.select(F.col("o_orderkey").alias("item_id"), *[c.alias(n) for n, c in wide.items()])


@query("taxonomy_two_arms", """
SELECT arm, label, count(*) AS n FROM orders JOIN (VALUES
  ('STRICT', 'F', 'done'), ('HIERARCHY', 'F', 'done'), ('HIERARCHY', 'O', 'open')) m(arm, raw, label) ON o_orderstatus = raw
GROUP BY ALL""", ints="n")
def taxonomy_two_arms(spark, sf_dir):
    """Two mapping arms in one pass; unmapped status P is dropped."""
    orders = I.table(spark, sf_dir, "orders")
    statuses = orders.select(F.col("o_orderstatus").alias("raw_label")).distinct()
    rules = F.array(*[
        F.struct(F.lit(a).alias("arm"), F.lit(r).alias("raw"), F.lit(t).alias("label"))
        for a, r, t in [("STRICT", "F", "done"), ("HIERARCHY", "F", "done"), ("HIERARCHY", "O", "open")]])
    mapping = statuses.select("raw_label", F.inline(rules)).where("raw_label = raw").select("arm", "raw_label", "label")
    return joins.apply_taxonomy(orders, mapping, "o_orderstatus").groupBy("arm", "label").agg(
        F.count(F.lit(1)).alias("n"))


@query("scale_to_stratum", I.ORDERS_SQL + """
SELECT CASE WHEN r1 <= 2 THEN 'Light' WHEN r1 <= 4 THEN 'Medium' ELSE 'Dark' END AS stratum,
       CASE WHEN r2 - 1 <= 1 THEN 'Dark' WHEN r2 - 1 <= 3 THEN 'Medium' ELSE 'Light' END AS inverted, count(*) AS n
FROM items GROUP BY ALL""", ints="n")
def scale_to_stratum(spark, sf_dir):
    """Six-point scale to three strata, plain and inverted."""
    return I.order_items(spark, sf_dir).groupBy(
        L.map_values(F.col("r1"), L.SCALE_TO_STRATUM).alias("stratum"),
        L.map_values(F.col("r2") - 1, L.INVERTED_SCALE_TO_STRATUM).alias("inverted"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_and_range_filter", """
WITH p AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS raw FROM events),
n AS (SELECT event_id, TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE raw END AS DOUBLE) AS v FROM p)
SELECT event_id, CASE WHEN v BETWEEN 10 AND 60 THEN v END AS number FROM n""", doubles="number")
def coerce_and_range_filter(spark, sf_dir):
    """Number of a text field, malformed or out of range gives NULL."""
    raw = F.get_json_object("props", "$.k")
    dirty = F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(raw)
    return I.table(spark, sf_dir, "events").select("event_id", L.to_number(dirty, 10, 60).alias("number"))


@query("host_class", """
SELECT CASE WHEN url IS NULL THEN 'unknown' WHEN contains(lower(url), '.com/') THEN 'commercial'
            WHEN contains(lower(url), '.net/') OR contains(lower(url), '.org/') THEN 'network' ELSE 'other' END AS host,
       count(*) AS n FROM (SELECT CASE WHEN page_id % 17 <> 0 THEN url END AS url FROM pages) GROUP BY ALL""", ints="n")
def host_class(spark, sf_dir):
    url = F.when(F.col("page_id") % 17 != 0, F.col("url"))
    rules = [("commercial", [".com/"]), ("network", [".net/", ".org/"])]
    return I.table(spark, sf_dir, "pages").groupBy(L.host_class(url, rules).alias("host")).agg(
        F.count(F.lit(1)).alias("n"))


@query("confidence_levels", f"WITH{I.ITEMS_SQL}" + """
SELECT stratum, count(*) FILTER (WHERE confidence >= 0.6) AS n_06, count(*) FILTER (WHERE confidence >= 0.8) AS n_08,
       count(*) FILTER (WHERE confidence >= 0.6 AND NOT flag) AS n_06_unflagged FROM items GROUP BY ALL
""", ints="n_06 n_08 n_06_unflagged")
def confidence_levels(spark, sf_dir):
    """Two thresholds and the arm without flagged items, from one scan."""
    c = F.col("confidence")
    return I.embedding_items(spark, sf_dir).groupBy("stratum").agg(
        F.count_if(c >= 0.6).alias("n_06"), F.count_if(c >= 0.8).alias("n_08"),
        F.count_if((c >= 0.6) & ~F.col("flag")).alias("n_06_unflagged"))


@query("flag_exclusion", f"WITH{I.ITEMS_SQL}" + """
SELECT item_id, stratum, confidence FROM items WHERE confidence >= 0.6 AND NOT flag""", doubles="confidence")
def flag_exclusion(spark, sf_dir):
    rows = I.embedding_items(spark, sf_dir)
    return rows.where((F.col("confidence") >= 0.6) & ~F.col("flag")).select("item_id", "stratum", "confidence")


@query("rater_agreement_rows", """
SELECT vec_id AS item_id, r1 FROM (
  SELECT vec_id, CASE WHEN vec_id % 4 <> 0 THEN vec_id % 6 END AS r1, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 12 % 7 END AS r2
  FROM embeddings) WHERE r1 IS NOT NULL AND r2 IS NOT NULL AND r1 = r2""", ints="r1")
def rater_agreement_rows(spark, sf_dir):
    v = F.col("vec_id")
    rows = I.table(spark, sf_dir, "embeddings").select(
        v.alias("item_id"), F.when(v % 4 != 0, v % 6).alias("r1"), F.when(v % 3 != 0, v % 12 % 7).alias("r2"))
    return rows.where(F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("r1") == F.col("r2"))).select(
        "item_id", "r1")


ROMAN = ["I", "II", "III", "IV", "V", "VI", "none"]


@query("roman_skin_types", f"""
WITH t AS (SELECT {I.sql_list(ROMAN)}[o_orderkey % 7 + 1] AS roman FROM orders)
SELECT roman, {I.sql_case('roman', L.ROMAN_TO_THREE)} AS three, {I.sql_case('roman', L.ROMAN_TO_FIVE)} AS five, count(*) AS n
FROM t WHERE roman <> 'none' GROUP BY ALL""", ints="n")
def roman_skin_types(spark, sf_dir):
    """Roman types to three and five classes; anything else is dropped."""
    roman = F.get(F.array(*[F.lit(r) for r in ROMAN]), (F.col("o_orderkey") % 7).cast("int"))
    rows = I.table(spark, sf_dir, "orders").select(roman.alias("roman")).select(
        "roman", L.map_values(F.col("roman"), L.ROMAN_TO_THREE).alias("three"),
        L.map_values(F.col("roman"), L.ROMAN_TO_FIVE).alias("five"))
    return rows.where(F.col("three").isNotNull()).groupBy("roman", "three", "five").agg(F.count(F.lit(1)).alias("n"))


@query("class_folding", """
WITH t AS (SELECT o_orderkey % 12 AS m, o_orderkey % 5 AS five, o_orderkey % 6 AS six FROM orders)
SELECT m, CASE WHEN m IN (1, 2) THEN 'Very Light (MST 1-2)' WHEN m IN (3, 4) THEN 'Light (MST 3-4)'
     WHEN m IN (5, 6) THEN 'Medium (MST 5-6)' WHEN m IN (7, 8) THEN 'Dark (MST 7-8)' WHEN m IN (9, 10) THEN 'Very Dark (MST 9-10)' END AS name,
   CASE WHEN five <= 1 THEN 0 WHEN five <= 3 THEN 1 ELSE 2 END AS three, six // 2 AS halved, count(*) AS n
FROM t GROUP BY ALL""", ints="m three halved n")
def class_folding(spark, sf_dir):
    """Ten-point ratings to names, five to three classes, six to three."""
    k = F.col("o_orderkey")
    return I.table(spark, sf_dir, "orders").groupBy(
        (k % 12).alias("m"), L.mst10_name(k % 12).alias("name"),
        L.map_values(k % 5, L.MST5_TO_MST3).alias("three"), L.halve_class(k % 6).alias("halved"),
    ).agg(F.count(F.lit(1)).alias("n"))


ITA_BINS = " ".join(f"WHEN ita < {b} THEN {i}" for i, b in enumerate(L.ITA_INNER_BOUNDS))


@query("ita_bins", I.ARRAYS_SQL + f""",
a AS (SELECT item_id, CASE WHEN item_id % 19 = 0 THEN NULL
        ELSE degrees(atan2((50 + 100 * cells[1]) - 50, 100 * cells[33])) END AS ita FROM arrays),
b AS (SELECT *, CASE WHEN ita IS NULL THEN -1 {ITA_BINS} ELSE 9 END AS mst10 FROM a)
SELECT item_id, ita, mst10, CASE WHEN mst10 < 0 THEN -1 ELSE mst10 // 2 END AS mst5,
       CASE WHEN mst10 < 0 THEN 'unknown' ELSE {I.sql_list(L.MST5_NAMES)}[mst10 // 2 + 1] END AS name FROM b
""", ints="mst10 mst5", doubles="ita")
def ita_bins(spark, sf_dir):
    """Typology angle and its bins; a missing angle is -1 and unknown."""
    cells = F.col("cells")
    angle = L.ita_angle(50 + 100 * F.get(cells, F.lit(0)), 100 * F.get(cells, F.lit(32)))
    rows = I.arrays_8x8(spark, sf_dir).withColumn("ita", F.when(F.col("item_id") % 19 != 0, angle))
    return rows.select(
        "item_id", "ita", L.ita_to_mst10(F.col("ita")).alias("mst10"), L.ita_to_mst5(F.col("ita")).alias("mst5"),
        L.mst5_name(L.ita_to_mst5(F.col("ita"))).alias("name"))


@query("adjacent_probability_sums", I.VECTORS_SQL + """,
g AS (SELECT item_id, CAST(substr(k, 2) AS INT) // 2 AS g, sum(p) AS p FROM probs WHERE model = 'lambda10' GROUP BY ALL)
SELECT item_id, max(p) FILTER (WHERE g = 0) AS g0, max(p) FILTER (WHERE g = 4) AS g4, arg_max(g, p) AS best FROM g GROUP BY item_id
""", ints="best", doubles="g0 g4")
def adjacent_probability_sums(spark, sf_dir):
    """Neighbouring class probabilities added, then the largest group."""
    rows = I.embedding_scores(spark, sf_dir, {"lambda10": 64})
    sums = rows.select("item_id", L.add_adjacent(F.col("probs"), 2, 5).alias("s"))
    return sums.select("item_id", F.get("s", F.lit(0)).alias("g0"), F.get("s", F.lit(4)).alias("g4"),
                       (L.first_max(F.col("s")) - 1).alias("best"))


@query("predicted_class_and_tier", I.VECTORS_SQL + """
SELECT item_id, model, pred_class, score AS confidence, CASE WHEN score >= 0.12 THEN 'high' ELSE 'low' END AS tier,
       CASE WHEN score < 0.15 THEN 'high' ELSE 'low' END AS spread_tier FROM scored""", doubles="confidence")
def predicted_class_and_tier(spark, sf_dir):
    """Arg-max class, its probability and the confidence tier."""
    rows = I.embedding_scores(spark, sf_dir)
    top = F.array_max("probs")
    return rows.select(
        "item_id", "model", L.predicted_class(F.col("probs"), CLASSES).alias("pred_class"), top.alias("confidence"),
        L.tier(top, 0.12).alias("tier"), L.tier(top, 0.15, high_if_below=True).alias("spread_tier"))


@query("softmax_scores", I.VECTORS_SQL + """
SELECT item_id, k AS class, p FROM probs WHERE model = 'orig'""", doubles="p")
def softmax_scores(spark, sf_dir):
    rows = I.embedding_scores(spark, sf_dir, {"orig": 8})
    zipped = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in CLASSES]).alias("class"), F.col("probs").alias("p")))
    return rows.select("item_id", zipped.alias("z")).select("item_id", "z.class", "z.p")


PATH_SQL = "split_part(split_part(url, '?', 1), '#', 1)"


@query("path_stems", f"""
WITH f AS (SELECT page_id, string_split({PATH_SQL} || '_overlay.jpg', '/')[-1] AS name FROM pages)
SELECT page_id, name, regexp_extract(name, '^(.+)\\.[^.]+$', 1) AS stem,
       replace(replace(name, '_overlay.jpg', ''), '.jpg', '') AS bare FROM f""")
def path_stems(spark, sf_dir):
    """File name, stem and name without known endings of a path."""
    path = F.concat(F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.lit("_overlay.jpg"))
    rows = I.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("page_id", name.alias("name"), L.stem(F.col("path")).alias("stem"),
                       L.strip_parts(name, ["_overlay.jpg", ".jpg"]).alias("bare"))


@query("rounded_outputs_and_names", """
SELECT lower(replace(replace(replace(replace(p_name || ' (' || p_brand || ')', ' ', '_'), '=', ''), '(', ''), ')', '')) AS safe,
       avg(p_retailprice) AS price, count(*) AS n FROM part GROUP BY ALL""", ints="n", doubles="price")
def rounded_outputs_and_names(spark, sf_dir):
    """Artifact names from labels, rounded outputs."""
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return I.table(spark, sf_dir, "part").groupBy(L.safe_name(name).alias("safe")).agg(
        F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))


@query("conform_columns", """
SELECT vec_id AS image_id, 'c' || label AS true_class, 'unknown' AS site, coalesce(CASE WHEN vec_id % 3 > 0 THEN 'm' || vec_id % 3 END, 'none') AS method
FROM embeddings""")
def conform_columns(spark, sf_dir):
    """Rename shim, missing column added, kept columns, NULLs filled."""
    v = F.col("vec_id")
    rows = I.table(spark, sf_dir, "embeddings").select(
        v.alias("isic_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("diagnosis"),
        F.when(v % 3 > 0, F.concat(F.lit("m"), (v % 3).cast("string"))).alias("method"), F.lit(1).alias("noise"))
    identifier = joins.detect_column(rows, joins.ID_COLUMNS)
    return joins.conform(
        rows, {identifier: "image_id", "diagnosis": "true_class"},
        ["image_id", "true_class", "site", "method", "not_there"],
        {"site": F.lit("unknown")}, {"method": "none"})


# --- joins and unions --------------------------------------------------------

@query("resolve_file_paths", f"""
WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS key, 'alt' || page_id AS alt FROM pages),
files AS (
  SELECT key || '.jpg' AS file FROM p WHERE {I.u("'jpg'", 'key')} < 0.5
  UNION SELECT key || '.png' FROM p WHERE {I.u("'png'", 'key')} < 0.4
  UNION SELECT key FROM p WHERE {I.u("'bare'", 'key')} < 0.2
  UNION SELECT alt || '.jpg' FROM p WHERE {I.u("'alt'", 'key')} < 0.3)
SELECT page_id, coalesce(
  (SELECT '/data/' || file FROM files WHERE file = key || '.jpg'), (SELECT '/data/' || file FROM files WHERE file = key || '.png'),
  (SELECT '/data/' || file FROM files WHERE file = key), (SELECT '/data/' || file FROM files WHERE file = alt || '.jpg')) AS path
FROM p""")
def resolve_file_paths(spark, sf_dir):
    """First existing candidate file per item, NULL if there is none."""
    items, listing = _path_tables(spark, sf_dir)
    return resolve_paths(items, listing, "key", (".jpg", ".png", ""), [("alt", (".jpg",))]).select("page_id", "path")


def _path_tables(spark, sf_dir):
    key = F.col("page_id").cast("string")
    items = I.table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.concat(F.lit("alt"), key).alias("alt"))
    names = F.array_compact(F.array(
        F.when(uniform("jpg", key) < 0.5, F.concat(key, F.lit(".jpg"))),
        F.when(uniform("png", key) < 0.4, F.concat(key, F.lit(".png"))),
        F.when(uniform("bare", key) < 0.2, key),
        F.when(uniform("alt", key) < 0.3, F.concat(F.lit("alt"), key, F.lit(".jpg")))))
    listing = items.select(F.explode(names).alias("file")).distinct()
    return items, listing.withColumn("path", F.concat(F.lit("/data/"), F.col("file")))


@query("missing_file_report", f"""
SELECT page_id FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS key FROM pages)
WHERE {I.u("'jpg'", 'key')} >= 0.5 AND {I.u("'png'", 'key')} >= 0.4 AND {I.u("'bare'", 'key')} >= 0.2
""")
def missing_file_report(spark, sf_dir):
    items, listing = _path_tables(spark, sf_dir)
    return missing_paths(resolve_paths(items, listing, "key", (".jpg", ".png", ""))).select("page_id")


@query("optional_metadata", f"WITH{I.ITEMS_SQL}" + """,
meta AS (SELECT vec_id % 50 AS k, min('site' || (vec_id % 7)) AS site FROM embeddings WHERE vec_id % 50 < 40 GROUP BY 1)
SELECT item_id, coalesce(site, 'UNKNOWN') AS site FROM items LEFT JOIN meta ON item_id % 50 = k""")
def optional_metadata(spark, sf_dir):
    """Left join with a deduplicated right side; no match is named."""
    v = F.col("vec_id")
    meta = I.table(spark, sf_dir, "embeddings").where(v % 50 < 40).select(
        (v % 50).alias("k"), F.concat(F.lit("site"), (v % 7).cast("string")).alias("site"))
    items = I.embedding_items(spark, sf_dir).select("item_id", (F.col("item_id") % 50).alias("k"))
    return joins.add_metadata(items, meta, "k", ["site", "absent"], {"site": "UNKNOWN"}).select("item_id", "site")


@query("overlay_fields", """
SELECT d.doc_id, coalesce('q' || l.quality, d.lang) AS tag, coalesce(CAST(l.toxic AS VARCHAR), 'none') AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def overlay_fields(spark, sf_dir):
    """Right side overrides a field; defaults where there is no match."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tag"))
    marks = I.table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"),
        F.col("toxic").cast("string").alias("toxic"))
    return joins.overlay(documents, marks, "doc_id", ["tag", "toxic"], {"toxic": F.lit("none")})


@query("listed_and_unlisted", """
SELECT 'listed' AS side, lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL
UNION ALL SELECT 'unlisted', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
""", ints="n")
def listed_and_unlisted(spark, sf_dir):
    """Semi join for kept ids, anti join for the dropped count."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    listed = I.table(spark, sf_dir, "labels")
    both = joins.keep_listed(documents, listed, "doc_id").withColumn("side", F.lit("listed")).unionByName(
        joins.drop_listed(documents, listed, "doc_id").withColumn("side", F.lit("unlisted")))
    return both.groupBy("side", "lang").agg(F.count(F.lit(1)).alias("n"))


SYNTHETIC_SQL = f"WITH{I.ITEMS_SQL}" + """,
manifest AS (SELECT 'x' || item_id || '.jpg' AS output_name, item_id AS source_id, 'Dark' AS target_class FROM items
             WHERE stratum = 'Light'),
synthetic AS (SELECT 'aug_' || output_name AS image_id, true_class, target_class || '/' || output_name AS path
              FROM manifest JOIN items ON source_id = item_id)"""


def _synthetic(spark, sf_dir):
    items = I.embedding_items(spark, sf_dir)
    manifest = items.where(F.col("stratum") == "Light").select(
        F.concat(F.lit("x"), F.col("item_id").cast("string"), F.lit(".jpg")).alias("output_name"),
        F.col("item_id").alias("source_id"), F.lit("Dark").alias("target_class"))
    truth = items.select(F.col("item_id").alias("image_id"), "true_class")
    return joins.inherit_labels(manifest, truth), truth


@query("inherited_labels", SYNTHETIC_SQL + " SELECT * FROM synthetic")
def inherited_labels(spark, sf_dir):
    """Synthetic items carry the label of their source."""
    return _synthetic(spark, sf_dir)[0]


@query("original_plus_synthetic", SYNTHETIC_SQL + """
SELECT CAST(item_id AS VARCHAR) AS image_id, true_class, NULL AS path, false AS is_synthetic FROM items
UNION ALL SELECT image_id, true_class, path, true FROM synthetic""")
def original_plus_synthetic(spark, sf_dir):
    synthetic, truth = _synthetic(spark, sf_dir)
    return joins.union_synthetic(truth.withColumn("image_id", F.col("image_id").cast("string")), synthetic)


@query("distinct_rows_and_keys", """
SELECT lang, source, doc_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1
""", ints="doc_id n_chars")
def distinct_rows_and_keys(spark, sf_dir):
    """One row per key, the smallest by a stated order."""
    rows = I.table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars").distinct()
    return joins.distinct_by_key(rows, ["lang", "source"], ["n_chars"])
