"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions.hashing import hash32
from evenhand.llm import context_tree
from evenhand.llm.bpe import encode
from evenhand.llm.hard_negatives import hard_negatives
from evenhand.llm.language import identify
from evenhand.llm.mixing import mix
from evenhand.llm.near_vectors import near_vectors
from evenhand.llm.neighbours import nearest
from evenhand.llm.periods import listed_runs, periodic_runs, strongest
from evenhand.llm.registry import QUERIES, SQL, query, table, tokenizer_file
from evenhand.llm.simhash import near_classes
from evenhand.llm.texts import WORD, remainder
from evenhand.llm.token_count import token_counts
from evenhand.llm.toxicity import score
from evenhand.llm.url_filter import BINS_PER_UNIT, FOLDS, ORDER, REACH, SMOOTHING, Rule, judge
from evenhand.llm.winnowing import beside_next

__all__ = ["QUERIES", "SQL"]

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
rows_ AS (
  SELECT doc_id, source, size, CASE WHEN source IS NULL THEN 'n' ELSE '=' || source END AS src,
         CAST('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), text)), 1, 8) AS BIGINT) AS h,
         length(bin(size + 1)) * 2 + CASE WHEN substr(bin(size + 1), 2, 1) = '1' THEN 1 ELSE 0 END AS class
  FROM sized),
sources AS (
  SELECT src, sum(size) AS source_size, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w
  FROM rows_ GROUP BY src),
steps AS (
  SELECT *, row_number() OVER need AS pos,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
           ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(w) OVER (ORDER BY source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources WINDOW need AS (ORDER BY source_size / w, src)),
free AS (
  SELECT pos, left_, rest FROM steps WHERE left_ * w < 3 * source_size * rest ORDER BY pos LIMIT 1),
targets AS (
  SELECT s.src, s.source_size, CASE WHEN f.pos IS NULL OR s.pos < f.pos THEN 3 * CAST(s.source_size AS DOUBLE)
         ELSE CAST(f.left_ AS DOUBLE) * s.w / f.rest END AS target,
         CAST('0x' || substr(md5('42|' || s.src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS offset_
  FROM steps s LEFT JOIN free f ON true),
numbered AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, t.offset_,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY r.src ORDER BY r.class, r.h % r.slices, r.size, r.h, r.doc_id) AS pos
  FROM (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY src, class) / 50000) AS BIGINT) AS slices FROM rows_) r
  JOIN targets t ON t.src = r.src),
copied AS (
  SELECT *, least(floor(pos * rate + offset_) - floor((pos - 1) * rate + offset_), 3) AS n FROM numbered)
SELECT doc_id, source, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(n AS INTEGER) AS copies, CAST(n * size AS BIGINT) AS taken
FROM copied
"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mix of all sources at the weights 1, 2, 3."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


URL_RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]


def url_sql() -> str:
    """SQL of the URL verdicts: one pair of tables for each context length."""
    rules = sorted(URL_RULES, key=lambda r: (len(r.host + r.path), r.verdict == "block"), reverse=True)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in rules) + " ELSE NULL END"
    levels, ratio, joins = [], "0.0", ""
    for k in range(ORDER + 1):
        end = f"substr(string, {ORDER + 1 - k}, {k + 1})"
        q_a, q_b = ("q.p_a", "q.p_b") if k else ("1 / 256.0::DOUBLE", "1 / 256.0::DOUBLE")
        shorter = f"JOIN l{k - 1} q ON q.string = substr(s.string, 2, {k})" if k else ""
        levels.append(f"""
seen{k} AS (SELECT {end} AS string, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
after{k} AS (SELECT substr(string, {ORDER + 1 - k}, {k}) AS context, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
l{k} AS (SELECT s.string, (s.a + {SMOOTHING}::DOUBLE * {q_a}) / (c.a + {SMOOTHING}::DOUBLE) AS p_a,
                (s.b + {SMOOTHING}::DOUBLE * {q_b}) / (c.b + {SMOOTHING}::DOUBLE) AS p_b
         FROM seen{k} s JOIN after{k} c ON c.context = substr(s.string, 1, {k}) {shorter}),""")
        ratio = f"coalesce(ln(l{k}.p_a) - ln(l{k}.p_b), {ratio})"
        joins += f" LEFT JOIN l{k} ON l{k}.string = substr(x.string, {ORDER + 1 - k}, {k + 1})"
    reach = REACH * BINS_PER_UNIT
    return rf"""
WITH split AS (
  SELECT page_id, url, row_number() OVER () AS row_,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
parts AS (
  SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS ruled,
         CAST('0x' || substr(md5(concat_ws('|', '42', url)), 1, 8) AS BIGINT) % {FOLDS} AS fold,
         repeat(chr(2), {ORDER}) || host || path AS text
  FROM split),
strings AS (
  SELECT row_, unnest(list_transform(range(1, length(text) - {ORDER} + 1), lambda i: substr(text, i, {ORDER + 1}))) AS string
  FROM parts),
counts AS (
  SELECT string, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM strings JOIN parts USING (row_) WHERE ruled IS NOT NULL AND fold <> 0 GROUP BY string),{"".join(levels)}
scores AS (SELECT row_, avg({ratio}) AS score FROM strings x{joins} GROUP BY row_),
scored AS (SELECT p.*, coalesce(s.score, 0.0) AS score FROM parts p LEFT JOIN scores s USING (row_)),
bins AS (
  SELECT greatest(least(floor(score * {BINS_PER_UNIT}), {reach}), -{reach}) AS step,
         count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scored WHERE ruled IS NOT NULL AND fold = 0 GROUP BY 1),
parted AS (
  SELECT coalesce(floor((lag(step) OVER (ORDER BY step) + 1 + step) / 2), step) AS middle, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b,
         coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low_a,
         coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low_b
  FROM bins),
best AS (
  SELECT middle FROM parted WHERE all_a > 0 AND all_b > 0
  ORDER BY (all_a - low_a) * all_b + low_b * all_a DESC, abs(middle), middle LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= coalesce((SELECT middle FROM best) / {BINS_PER_UNIT}, 0)
       THEN 'allow' ELSE 'block' END) AS verdict
FROM scored
"""


@query("op2_url_filter", url_sql())
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by rules or, where none fits, by the character models."""
    judged = judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is longer than 2,048 tokens."""
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_file())
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def toxic_labels(spark: SparkSession, sf_dir: str, docs: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc_id, text, toxic) of about ``most`` labelled documents outside the held-out fifth.

    Labels are narrow and cut by a hash of doc_id before they meet the texts, so the
    broadcast side has about ``most`` rows whatever the input.
    """
    labels = table(spark, sf_dir, "labels").where(
        (remainder("doc_id", 5) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = labels.count()
    chosen = labels if n <= most else labels.where(
        hash32(F.col("doc_id"), seed=7) < F.lit(int(2 ** 32 * most / n)))
    one_each = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(one_each), "doc_id")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    judged = score(docs, toxic_labels(spark, sf_dir, docs), max_examples=24_000)
    return judged.withColumn("held_out", remainder("doc_id", 5) == 0)


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs, docs.where(remainder("doc_id", 4) != 2))
    return judged.withColumn("held_out", remainder("doc_id", 4) == 2)


@query("op6_near_vectors")
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and kept flag of every vector at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at 2 differing bits or fewer."""
    return near_classes(table(spark, sf_dir, "documents")).drop("root")


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others, by inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op9_context_tree")
def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and single-word scores of every document, learned outside the held-out tenth."""
    return context_tree.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = encode(table(spark, sf_dir, "documents"), tokenizer_file(), decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by the key's hash, continue periodically from some word on."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(mark / 10).alias("g"), F.when(
        mark % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"))).alias("words")).withColumn("n", F.size("words"))
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("words", F.col("a") + i % F.col("p") + 1)))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periods")
def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the strongest of them, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    milli = F.floor(1000 * F.col("best.length").cast("decimal(30,0)") / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        milli.alias("exponent_milli"), F.sha2(listed_runs(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_winnowing")
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its text edited with the next document; 8 digits for each chosen hash."""
    found = beside_next(table(spark, sf_dir, "documents"))
    digits = lambda prints: F.array_join(F.transform(
        prints, lambda h: F.lpad(F.lower(F.hex(F.shiftright(h, 31))), 8, "0")), "")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits("prints").alias("fingerprint"), digits("edited_prints").alias("edited_fingerprint"), "near_edited", "near_next")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank",
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY "rank" <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector for each of its five positives."""
    whole = table(spark, sf_dir, "embeddings")
    parts = F.col("embedding").cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole.where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", label.alias("label"), F.transform(parts, lambda x: F.floor(256 * x)).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
