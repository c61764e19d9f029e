"""Whole jobs: external manifest, stratified audit, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.labels import _path_tables
from catalog.registry import query
from catalog.sampling import _allocation
from evenhand.plans.audit import stratified_audit
from evenhand.plans.curation import build_pairs, curate_records
from evenhand.plans.manifest import dual_rater_manifest

HOSTS = ["http://www.dermaamin.com/p", "http://Atlas-Dermatologico.org/p", "http://example.net/p"]


@query("external_manifest", f"""
WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS key, 'alt' || page_id AS alt, page_id % 5 AS raw,
           CASE WHEN page_id % 9 = 8 THEN 'x' ELSE CAST(page_id % 8 AS VARCHAR) END AS scale FROM pages),
files AS (
  SELECT key || '.jpg' AS file FROM p WHERE {I.u("'jpg'", 'key')} < 0.5
  UNION SELECT key || '.png' FROM p WHERE {I.u("'png'", 'key')} < 0.4
  UNION SELECT key FROM p WHERE {I.u("'bare'", 'key')} < 0.2
  UNION SELECT alt || '.jpg' FROM p WHERE {I.u("'alt'", 'key')} < 0.3),
m(mapping, raw, true_class) AS (VALUES ('STRICT', 0, 'MEL'), ('STRICT', 1, 'NV'), ('HIERARCHY', 0, 'MEL'), ('HIERARCHY', 1, 'NV'), ('HIERARCHY', 2, 'NV')),
r AS (SELECT key AS image_id, mapping, true_class, TRY_CAST(scale AS INT) AS s, page_id, coalesce(
  (SELECT '/data/' || file FROM files WHERE file = key || '.jpg'), (SELECT '/data/' || file FROM files WHERE file = key || '.png'),
  (SELECT '/data/' || file FROM files WHERE file = key), (SELECT '/data/' || file FROM files WHERE file = alt || '.jpg')) AS path
  FROM p JOIN m USING (raw))
SELECT image_id, path, true_class, s AS fitzpatrick_scale,
       CASE WHEN s <= 2 THEN 'Light' WHEN s <= 4 THEN 'Medium' ELSE 'Dark' END AS fst_tertile,
       ['dermaamin', 'atlas_dermatologico', 'other'][page_id % 3 + 1] AS source, mapping
FROM r WHERE s BETWEEN 1 AND 6 AND path IS NOT NULL""", ints="fitzpatrick_scale")
def external_manifest(spark, sf_dir):
    """Taxonomy, scale, host class and file path of an external set, two arms in one pass."""
    items, listing = _path_tables(spark, sf_dir)
    k = F.col("page_id")
    raw = items.select(
        F.col("key").alias("md5hash"), F.col("alt").alias("url_alphanum"), F.concat(F.lit("d"), (k % 5).cast("string")).alias("label"),
        F.when(k % 9 == 8, "x").otherwise((k % 8).cast("string")).alias("fitzpatrick_scale"),
        F.get(F.array(*[F.lit(h) for h in HOSTS]), (k % 3).cast("int")).alias("url"))
    rules = [("STRICT", "d0", "MEL"), ("STRICT", "d1", "NV"), ("HIERARCHY", "d0", "MEL"), ("HIERARCHY", "d1", "NV"), ("HIERARCHY", "d2", "NV")]
    taxonomy = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("arm"), F.lit(r).alias("raw_label"), F.lit(t).alias("label")) for a, r, t in rules])))
    # Three candidates per item here: no .jpeg files and no bare alternative names are listed.
    return dual_rater_manifest(raw, listing, taxonomy).drop("fitzpatrick_centaur", "qc_flag")


def _audit(spark, sf_dir):
    items = I.embedding_items(spark, sf_dir)
    scores = I.embedding_scores(spark, sf_dir)
    return stratified_audit(
        items.select(F.col("item_id").alias("image_id"), "stratum", "confidence", "flag"),
        items.select(F.col("item_id").alias("image_id"), "true_class"),
        scores.select("model", F.col("item_id").alias("image_id"), "pred_class", "probs"),
        list(I.MODELS), "orig", I.VECTOR_CLASSES, I.VECTOR_CLASSES, exclude_flag="flag",
        metadata=items.select(F.col("item_id").alias("image_id"), F.col("method").alias("source")))


AUDIT_SQL = I.VECTORS_SQL + """,
main AS (SELECT * FROM scored WHERE confidence >= 0.6 AND NOT flag),
cells0 AS (SELECT model, stratum, true_class, pred_class, count(*) AS n FROM main GROUP BY ALL),
cells AS (SELECT * FROM cells0 UNION ALL SELECT model, 'Overall', true_class, pred_class, sum(n) FROM cells0 GROUP BY ALL),
per_class AS (
  SELECT model, stratum, class, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, stratum, true_class AS class, n AS support, 0 AS predicted, CASE WHEN true_class = pred_class THEN n ELSE 0 END AS tp FROM cells
    UNION ALL SELECT model, stratum, pred_class, 0, n, 0 FROM cells) GROUP BY ALL),
f AS (SELECT model, stratum, sum(support) AS n, sum(tp)::DOUBLE / sum(support) AS accuracy,
      sum(2.0::DOUBLE * tp / (support + predicted)) / 10 AS macro_f1 FROM per_class GROUP BY ALL),
long AS (SELECT m.model, m.stratum, p.k AS class, true_class, p.p AS score FROM main m JOIN probs p USING (model, item_id)),
lall AS (SELECT * FROM long UNION ALL SELECT model, 'Overall', class, true_class, score FROM long),
pairs AS (SELECT a.model, a.stratum, a.class, count(*) AS n, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE
     WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) AS u FROM lall a JOIN lall b ON a.model = b.model AND a.stratum = b.stratum AND a.class = b.class
     WHERE a.true_class = a.class AND b.true_class <> b.class GROUP BY ALL),
auc AS (SELECT model, stratum, avg(u / n) AS macro_auc FROM pairs GROUP BY ALL)"""


@query("audit_job_metrics", AUDIT_SQL + """
SELECT model, stratum, n, accuracy, macro_f1, macro_auc FROM f LEFT JOIN auc USING (model, stratum)""",
       ints="n", doubles="accuracy macro_f1 macro_auc")
def audit_job_metrics(spark, sf_dir):
    """Main table of the audit job: confident, unflagged items."""
    return _audit(spark, sf_dir).metrics.select(*"model stratum n accuracy macro_f1 macro_auc".split())


@query("audit_job_sources", AUDIT_SQL + """,
o AS (SELECT stratum, method AS source, count(*) AS c FROM main WHERE model = 'orig' GROUP BY ALL),
a AS (SELECT * FROM o UNION ALL SELECT 'Overall', source, sum(c) FROM o GROUP BY source)
SELECT stratum, source, c AS count, c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY stratum) AS pct FROM a""", ints="count", doubles="pct")
def audit_job_sources(spark, sf_dir):
    """Source audit of the same job."""
    return _audit(spark, sf_dir).source_composition


@query("curation_job_splits", I.DOCUMENTS_SQL + f""",
d AS (SELECT image_id, label AS c FROM gated WHERE reason IS NULL),
counts AS (SELECT c, count(*)::BIGINT AS n FROM d GROUP BY c),
{_allocation('train', 'n', '(sum(n) OVER () - ceil(sum(n) OVER () * 0.15::DOUBLE))::BIGINT', 'counts')},
rest AS (SELECT *, (n - n_train)::BIGINT AS m FROM train),
{_allocation('val', 'm', '(sum(m) OVER () - ceil(sum(m) OVER () * 0.333::DOUBLE))::BIGINT', 'rest')},
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY c ORDER BY {I.h('image_id')}, image_id) AS rn FROM d)
SELECT image_id, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validation' ELSE 'test' END AS split,
       md5(text) AS answer FROM ranked JOIN val USING (c) JOIN records USING (image_id)""")
def curation_job_splits(spark, sf_dir):
    """Gate, split and chat records of the curation job."""
    from catalog.texts import _classifier_records

    job = curate_records(_classifier_records(spark, sf_dir), I.LEXICON)
    return job.conversations.select("image_id", "split", F.md5(F.expr("messages[2].content[0].text")).alias("answer"))


METADATA_SQL = f"""WITH records AS (
  SELECT conv_id, turn, text, CASE WHEN conv_id % 2 = 0 THEN {I.sql_list(I.LEXICON.keywords)}[conv_id % 4 + 1] ELSE 'unknown' END AS label,
         CASE WHEN conv_id % 2 = 0 THEN {I.sql_list(I.REGIONS)}[conv_id % 6 + 1] ELSE 'center' END AS focus
  FROM conversations WHERE role = 'assistant'),
{I._text_checks('records')},
ends AS (SELECT conv_id, first(turn ORDER BY points DESC, turn) AS best_turn, last(turn ORDER BY points DESC, turn) AS worst_turn,
    max(points) AS hi, min(points) AS lo FROM gated GROUP BY conv_id)
SELECT ends.conv_id, b.text AS chosen, w.text AS rejected, hi / 100.0::DOUBLE AS chosen_score, lo / 100.0::DOUBLE AS rejected_score
FROM ends JOIN gated b ON b.conv_id = ends.conv_id AND b.turn = best_turn
JOIN gated w ON w.conv_id = ends.conv_id AND w.turn = worst_turn WHERE hi - lo >= 20"""


@query("pairs_from_metadata", METADATA_SQL, doubles="chosen_score rejected_score")
def pairs_from_metadata(spark, sf_dir):
    """Candidates scored against the metadata of their item; items without metadata use the defaults."""
    candidates = I.candidate_texts(spark, sf_dir).select("conv_id", "turn", "teacher_reasoning")
    metadata = I.candidate_texts(spark, sf_dir).where("conv_id % 2 = 0").select(
        "conv_id", "predicted_class", "gradcam_spatial_region").distinct()
    pairs = build_pairs(candidates, metadata, "conv_id", "turn", "teacher_reasoning", I.LEXICON, target=None)
    return pairs.select("conv_id", "chosen", "rejected", "chosen_score", "rejected_score")
