"""Text gate, scores, chat records and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from evenhand.functions import text as tx
from evenhand.functions.hashing import uniform
from evenhand.functions.text import EXPECTED_KEYWORDS
from evenhand.operators import gate, joins, preference, ranking
from evenhand.plans import curation

PASS = ", ".join(f"pass_{c}" for c in gate.CHECKS)


def _checked(spark, sf_dir):
    return gate.run_checks(I.document_records(spark, sf_dir), I.LEXICON)


def _candidates(spark, sf_dir):
    return gate.run_checks(I.candidate_texts(spark, sf_dir), I.LEXICON)


@query("keyword_check", I.DOCUMENTS_SQL + """
SELECT image_id, array_to_string(matched, ',') AS matched, pass_keywords FROM checked""")
def keyword_check(spark, sf_dir):
    """Expected keywords of the class found in the whole text."""
    return _checked(spark, sf_dir).select("image_id", F.concat_ws(",", "keywords_matched").alias("matched"), "pass_keywords")


@query("listed_keyword_check", """
WITH d AS (SELECT doc_id, lower(text) AS low, CASE WHEN doc_id % 2 = 0 THEN ['the', 'und', 'que'] END AS listed FROM documents)
SELECT doc_id AS image_id, CASE WHEN listed IS NULL THEN 'class' ELSE 'listed' END AS origin,
       len(list_filter(coalesce(listed, ['lesion', 'skin']), lambda x: contains(low, x))) AS n FROM d""", ints="n")
def listed_keyword_check(spark, sf_dir):
    """An explicit keyword list on the row wins over the class list."""
    rows = I.document_records(spark, sf_dir).withColumns({
        "listed": F.when(F.col("image_id") % 2 == 0, F.array(*[F.lit(w) for w in ("the", "und", "que")])),
        "predicted_class": F.lit("other")})
    checked = gate.run_checks(rows, I.LEXICON, listed="listed")
    return checked.select("image_id", F.when(F.col("listed").isNull(), "class").otherwise("listed").alias("origin"),
                          F.size("keywords_matched").alias("n"))


@query("whole_word_check", """
SELECT doc_id AS image_id, regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9_])con([^a-zà-ÿ0-9_]|$)') AS found FROM documents""")
def whole_word_check(spark, sf_dir):
    """Whole-word matching instead of substrings."""
    rows = I.document_records(spark, sf_dir)
    return rows.select("image_id", tx.mentions(F.lower("teacher_reasoning"), "con", word_boundary=True).alias("found"))


@query("reject_phrase_check", I.DOCUMENTS_SQL + " SELECT image_id, phrase, pass_indeterminate FROM checked")
def reject_phrase_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("image_id", F.col("reject_phrase").alias("phrase"), "pass_indeterminate")


@query("region_check", I.DOCUMENTS_SQL + """
SELECT image_id, focus, array_to_string(conflicts, ',') AS conflicts, pass_spatial FROM checked""")
def region_check(spark, sf_dir):
    """Regions named in the text must not oppose the focus region."""
    return _checked(spark, sf_dir).select(
        "image_id", F.col("gradcam_spatial_region").alias("focus"),
        F.concat_ws(",", "region_conflicts").alias("conflicts"), "pass_spatial")


@query("length_check", I.DOCUMENTS_SQL + " SELECT image_id, word_count, pass_length FROM checked", ints="word_count")
def length_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("image_id", "word_count", "pass_length")


@query("safety_check", I.DOCUMENTS_SQL + " SELECT image_id, problem, pass_safety FROM checked")
def safety_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("image_id", F.col("safety_problem").alias("problem"), "pass_safety")


@query("text_gate", I.DOCUMENTS_SQL + """
SELECT image_id, label, reason, CASE WHEN reason IS NULL THEN word_count END AS words,
       CASE WHEN reason IS NULL THEN array_to_string(matched, ',') END AS matched FROM gated""", ints="words")
def text_gate(spark, sf_dir):
    """Five checks in order; the first failure names the reason, kept rows get metadata."""
    gated = gate.gate(_checked(spark, sf_dir))
    kept = F.col("qc_metadata").isNotNull()
    return gated.select(
        "image_id", F.col("predicted_class").alias("label"), "reason", F.col("qc_metadata.word_count").alias("words"),
        F.when(kept, F.concat_ws(",", "qc_metadata.keywords_matched")).alias("matched"))


@query("gate_report", I.DOCUMENTS_SQL + """,
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS k FROM gated),
r AS (SELECT v AS name FROM (VALUES ('keyword_fail'), ('indeterminate'), ('spatial_misalign'), ('length_fail'), ('safety_fail')) a(v))
SELECT 'total' AS section, unnest(['input', 'clean', 'discarded']) AS name, unnest([n, k, n - k]) AS count,
       unnest([n, k, n - k])::DOUBLE / n AS share FROM t
UNION ALL SELECT 'reason', name, count(reason), count(reason)::DOUBLE / (SELECT n FROM t) FROM r LEFT JOIN gated ON name = reason GROUP BY name
UNION ALL SELECT 'class', label, count(*), count(*)::DOUBLE / (SELECT n FROM t) FROM gated WHERE reason IS NULL GROUP BY label
UNION ALL SELECT 'threshold', 'meets_minimum', (k >= 100)::INT, NULL FROM t""", ints="count", doubles="share")
def gate_report(spark, sf_dir):
    """Totals, discards per reason, kept per class, whether the minimum is met."""
    return gate.gate_report(gate.gate(_checked(spark, sf_dir)), minimum=100)


@query("response_scores", I.CANDIDATES_SQL + """
SELECT conv_id, turn, points / 100.0::DOUBLE AS score, passed FROM gated""", doubles="score")
def response_scores(spark, sf_dir):
    """Weighted score of each candidate text."""
    return preference.score_candidates(_candidates(spark, sf_dir)).select("conv_id", "turn", "score", "passed")


@query("pass_rates", I.DOCUMENTS_SQL + """
SELECT count(*) AS n, avg(passed::INT) AS overall_rate, avg(pass_keywords::INT) AS keywords_rate,
       avg(pass_indeterminate::INT) AS indeterminate_rate, avg(pass_spatial::INT) AS spatial_rate,
       avg(pass_length::INT) AS length_rate, avg(pass_safety::INT) AS safety_rate, avg(word_count) AS mean_words,
       quantile_cont(word_count, 0.5) AS median_words FROM gated
""", ints="n", doubles="overall_rate keywords_rate indeterminate_rate spatial_rate length_rate safety_rate mean_words median_words")
def pass_rates(spark, sf_dir):
    """Pass rate per check, mean and interpolated median word count."""
    return gate.pass_rates(_checked(spark, sf_dir))


@query("class_pass_rates", I.DOCUMENTS_SQL + """
SELECT label AS class, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, avg(passed::INT) AS rate FROM gated GROUP BY label
""", ints="n passed", doubles="rate")
def class_pass_rates(spark, sf_dir):
    return gate.class_pass_rates(_checked(spark, sf_dir))


@query("pass_rates_by_source", I.DOCUMENTS_SQL + """
SELECT source, count(*) AS n, avg(passed::INT) AS overall_rate, avg(word_count) AS mean_words,
       quantile_cont(word_count, 0.5) AS median_words FROM gated GROUP BY source
""", ints="n", doubles="overall_rate mean_words median_words")
def pass_rates_by_source(spark, sf_dir):
    return gate.pass_rates(_checked(spark, sf_dir), ["source"]).select(
        "source", "n", "overall_rate", "mean_words", "median_words")


HEAD_SQL = I.CANDIDATES_SQL + """,
r AS (SELECT conv_id, turn % 2 AS side, n_passed, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS rn FROM gated),
o AS (SELECT CASE WHEN a.n_passed > b.n_passed THEN 'even' WHEN b.n_passed > a.n_passed THEN 'odd' ELSE 'tie' END AS outcome
      FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.rn = b.rn AND a.side = 0 AND b.side = 1)"""


@query("head_to_head", HEAD_SQL + """
SELECT v AS outcome, count(outcome) AS n, coalesce(count(outcome)::DOUBLE / nullif((SELECT count(*) FROM o), 0), 0) AS share
FROM (VALUES ('even'), ('odd'), ('tie')) f(v) LEFT JOIN o ON v = outcome GROUP BY v""", ints="n", doubles="share")
def head_to_head(spark, sf_dir):
    """Even against odd assistant turns, paired by their rank in the conversation."""
    checked = _candidates(spark, sf_dir).withColumn("side", F.col("turn") % 2)
    bucket = F.floor(F.col("turn") / 65536).cast("bigint")
    numbered = ranking.number_rows(checked, ["conv_id", "side"], ["turn"], bucket, "rank")
    return gate.head_to_head(
        numbered.where("side = 0"), numbered.where("side = 1"), ["conv_id", "rank"], ("even", "odd"))


@query("head_to_head_documents", I.DOCUMENTS_SQL + """,
o AS (SELECT CASE WHEN a.n_passed > b.n_passed THEN 'first' WHEN b.n_passed > a.n_passed THEN 'second' ELSE 'tie' END AS outcome
      FROM gated a JOIN gated b ON a.image_id % 2 = 0 AND b.image_id = a.image_id + 1)
SELECT outcome, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM o GROUP BY outcome""", ints="n", doubles="share")
def head_to_head_documents(spark, sf_dir):
    """Neighbouring documents as the two answers to one item, joined on the item id."""
    checked = _checked(spark, sf_dir).withColumn("item", F.floor(F.col("image_id") / 2))
    even = F.col("image_id") % 2 == 0
    return gate.head_to_head(checked.where(even), checked.where(~even), ["item"], ("first", "second"))


BEST_SQL = I.CANDIDATES_SQL + """,
ends AS (SELECT conv_id, first(turn ORDER BY points DESC, turn) AS best_turn, last(turn ORDER BY points DESC, turn) AS worst_turn,
    max(points) AS hi, min(points) AS lo FROM gated GROUP BY conv_id)"""


@query("best_and_worst", BEST_SQL + """
SELECT conv_id, best_turn, worst_turn, hi / 100.0::DOUBLE AS best_score, lo / 100.0::DOUBLE AS worst_score FROM ends
""", ints="best_turn worst_turn", doubles="best_score worst_score")
def best_and_worst(spark, sf_dir):
    """Best and worst candidate of an item; ties keep the candidate order."""
    scored = preference.score_candidates(_candidates(spark, sf_dir))
    ends = preference.best_and_worst(scored, ["conv_id"], "turn", "teacher_reasoning")
    return ends.select("conv_id", F.col("best.ordinal").alias("best_turn"), F.col("worst.ordinal").alias("worst_turn"),
                       F.col("best.score").alias("best_score"), F.col("worst.score").alias("worst_score"))


PAIRS_SQL = BEST_SQL + """,
pairs AS (SELECT ends.conv_id, b.text AS chosen, w.text AS rejected, hi / 100.0::DOUBLE AS chosen_score, lo / 100.0::DOUBLE AS rejected_score,
       'automated' AS source FROM ends JOIN gated b ON b.conv_id = ends.conv_id AND b.turn = best_turn
       JOIN gated w ON w.conv_id = ends.conv_id AND w.turn = worst_turn WHERE hi - lo >= 20)"""


def _pairs(spark, sf_dir, **kw):
    scored = preference.score_candidates(_candidates(spark, sf_dir))
    return preference.preference_pairs(scored, ["conv_id"], "turn", "teacher_reasoning", **kw)


@query("preference_pairs", PAIRS_SQL + " SELECT * FROM pairs", doubles="chosen_score rejected_score")
def preference_pairs(spark, sf_dir):
    """Best against worst where the score gap is at least 0.2."""
    return _pairs(spark, sf_dir).drop("chosen_details", "rejected_details")


@query("preference_pairs_target", PAIRS_SQL + " SELECT conv_id, chosen_score FROM pairs ORDER BY conv_id LIMIT 10", doubles="chosen_score")
def preference_pairs_target(spark, sf_dir):
    """At most a target number of pairs, first items first."""
    return _pairs(spark, sf_dir, target=10).select("conv_id", "chosen_score")


@query("pair_details", BEST_SQL + """
SELECT ends.conv_id, len(b.matched) AS matched, b.word_count AS words, w.pass_spatial AS worst_spatial
FROM ends JOIN gated b ON b.conv_id = ends.conv_id AND b.turn = best_turn
JOIN gated w ON w.conv_id = ends.conv_id AND w.turn = worst_turn WHERE hi - lo >= 20""", ints="matched words")
def pair_details(spark, sf_dir):
    """Per-check details carried by a pair."""
    return _pairs(spark, sf_dir).select(
        "conv_id", F.col("chosen_details.keywords.matched").alias("matched"),
        F.col("chosen_details.length.word_count").alias("words"),
        F.col("rejected_details.spatial.pass").alias("worst_spatial"))


@query("automatic_and_manual_pairs", PAIRS_SQL + """
SELECT conv_id, 'automated' AS source, md5(chosen) AS chosen, md5(rejected) AS rejected FROM pairs
UNION ALL SELECT conv_id, 'manual', md5(text), NULL FROM records WHERE turn = 1""")
def automatic_and_manual_pairs(spark, sf_dir):
    """Union with a manual side that lacks columns."""
    manual = I.candidate_texts(spark, sf_dir).where("turn = 1").select(
        "conv_id", F.lit("manual").alias("source"), F.col("teacher_reasoning").alias("chosen"))
    both = joins.union_pairs(_pairs(spark, sf_dir).select("conv_id", "source", "chosen", "rejected"), manual)
    return both.select("conv_id", "source", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query("review_template", """
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, text AS user_input, '' AS chosen, '' AS rejection_reason, 5 AS criteria
FROM (SELECT * FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 150)""", ints="id criteria")
def review_template(spark, sf_dir):
    """First 150 user messages with empty fields for a reviewer."""
    rows = I.table(spark, sf_dir, "conversations").where("role = 'user'")
    template = preference.review_template(rows, ["conv_id", "turn"], F.col("text"), 150)
    return template.select("id", "user_input", "chosen", "rejection_reason", F.size("alignment_criteria").alias("criteria"))


def _classifier_records(spark, sf_dir):
    """Documents as classifier records: name, confidence, class scores and focus words."""
    rows = I.document_records(spark, sf_dir)
    score = {c: F.round(uniform(c, F.col("image_id")), 2) for c in ("en", "fr", "de", "es")}
    name = F.initcap("predicted_class")
    return rows.withColumns({
        "predicted_name": name, "confidence": F.round(uniform("p", F.col("image_id")), 2),
        "all_scores": F.create_map(*[x for c, s in score.items() for x in (F.lit(c), s)]),
        "gradcam_intensity": F.lit("strong"), "cnn_correct": F.col("image_id") % 2 == 0,
        "image_path": F.concat(F.lit("/img/"), F.col("image_id").cast("string"), F.lit(".jpg")),
        "gradcam_overlay_path": F.concat(F.lit("/img/"), F.col("image_id").cast("string"), F.lit("_overlay.jpg")),
    })


@query("chat_records", """
SELECT doc_id AS image_id, 3 AS n_messages, 'system,user,assistant' AS roles, '1,3,1' AS parts,
       '/img/' || doc_id || '.jpg' AS first_image, md5(text) AS answer FROM documents""", ints="n_messages")
def chat_records(spark, sf_dir):
    """Record to chat messages; two images and a text on the user's turn."""
    chats = preference.create_conversations(_classifier_records(spark, sf_dir))
    return chats.select(
        "image_id", F.size("messages").alias("n_messages"), F.array_join("messages.role", ",").alias("roles"),
        F.array_join(F.transform("messages", lambda m: F.size(m["content"]).cast("string")), ",").alias("parts"),
        F.expr("messages[1].content[0].image").alias("first_image"), F.md5(F.expr("messages[2].content[0].text")).alias("answer"))


CLASS_SCORES = {c: f"round({I.u(repr(c), 'doc_id')}, 2)" for c in ("en", "fr", "de", "es")}
_scores = ", ".join(f"{{'c': '{c}', 's': {s}}}" for c, s in CLASS_SCORES.items())
_share = "printf('%.1f%%', {} * 100)".format
_json = " || ',' || chr(10) || ".join(
    f"'  \"{c}\": ' || CASE WHEN {s} = 0 THEN '0.0' ELSE {s}::VARCHAR END" for c, s in CLASS_SCORES.items())


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The two prompts of a document as a classifier record, in SQL: one row per document.
PROMPTS_SQL = f"""
facts AS (
  SELECT doc_id, upper(lang[1]) || lang[2:] AS name, round({I.u("'p'", 'doc_id')}, 2) AS confidence, doc_id % 2 = 0 AS correct,
         {I.sql_list(I.REGIONS)}[doc_id % 6 + 1] AS region, unnest([{_scores}]) AS e FROM documents),
prompts AS (
  SELECT doc_id, {_sql_text(preference.PROMPT_HEAD)} || '**Predicted Classification:** ' || any_value(name) || chr(10)
         || '**Confidence Score:** ' || {_share("any_value(confidence)")} || chr(10) || '**Grad-CAM Focus Region:** '
         || any_value(region) || ' (intensity: strong)' || chr(10) || chr(10) || '**All Class Probabilities:**' || chr(10)
         || string_agg('  - ' || e.c || ': ' || {_share("e.s")} || chr(10), '' ORDER BY e.s DESC, e.c)
         || {_sql_text(preference.PROMPT_TAIL)} AS user_text
  FROM facts GROUP BY doc_id)"""


@query("prompt_score_lines", f"WITH {PROMPTS_SQL} SELECT doc_id AS image_id, md5(user_text) AS prompt FROM prompts")
def prompt_score_lines(spark, sf_dir):
    """The whole prompt text: class scores highest first, percentages rounded half to even."""
    rows = _classifier_records(spark, sf_dir)
    return rows.select("image_id", F.md5(preference.user_prompt()).alias("prompt"))


@query("percent_texts", """
SELECT o_orderkey, printf('%.1f%%', round(o_totalprice / 1000000.0::DOUBLE, 4) * 100) AS share,
       printf('%.1f%%', (o_orderkey % 4000) / 4000.0::DOUBLE * 100) AS tie FROM orders""")
def percent_texts(spark, sf_dir):
    """One decimal from the exact binary value; exact ties go to the even digit."""
    rows = I.table(spark, sf_dir, "orders")
    price = F.round(F.col("o_totalprice").cast("double") / 1000000.0, 4)
    return rows.select("o_orderkey", preference.percent(price).alias("share"),
                       preference.percent((F.col("o_orderkey") % 4000).cast("double") / 4000.0).alias("tie"))


@query("teacher_prompts", f"""
SELECT doc_id AS image_id, md5('Analyze this dermoscopic image with the following CNN classification output:' || chr(10) || chr(10)
  || '**Predicted Diagnosis:** ' || upper(lang[1]) || lang[2:] || chr(10)
  || '**Confidence Score:** ' || {_share("round(" + I.u("'p'", 'doc_id') + ", 2)")} || chr(10)
  || '**CNN Correct vs Ground Truth:** ' || CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END || chr(10) || chr(10)
  || '**Top differential scores:**' || chr(10) || '{{' || chr(10) || {_json} || chr(10) || '}}' || chr(10) || chr(10)
  || '**Grad-CAM Analysis:**' || chr(10) || '- Primary activation region: ' || {I.sql_list(I.REGIONS)}[doc_id % 6 + 1] || chr(10)
  || '- Activation intensity: strong' || chr(10) || chr(10) || 'The first image is the original dermoscopic image.' || chr(10)
  || 'The second image is the Grad-CAM overlay showing which regions the CNN focused on.' || chr(10) || chr(10)
  || 'Provide a concise diagnostic reasoning paragraph.') AS prompt FROM documents""")
def teacher_prompts(spark, sf_dir):
    """The whole prompt for the reasoning model, scores as indented JSON."""
    return _classifier_records(spark, sf_dir).select("image_id", F.md5(preference.teacher_prompt()).alias("prompt"))


@query("null_texts", I.DOCUMENTS_SQL.replace("SELECT doc_id AS image_id, text,", "SELECT doc_id AS image_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text,") + """
SELECT label, count(*) AS n, avg(passed::INT) AS overall_rate, avg(pass_safety::INT) AS safety_rate,
       avg(pass_length::INT) AS length_rate, avg(word_count) AS mean_words, quantile_cont(word_count, 0.5) AS median_words
FROM gated GROUP BY label""", ints="n", doubles="overall_rate safety_rate length_rate mean_words median_words")
def null_texts(spark, sf_dir):
    """NULL texts are checked as empty ones: unsafe, too short and counted as no words."""
    rows = I.document_records(spark, sf_dir).withColumn(
        "teacher_reasoning", F.when(F.col("image_id") % 3 != 0, F.col("teacher_reasoning")))
    rates = gate.pass_rates(gate.run_checks(rows, I.LEXICON), ["predicted_class"])
    return rates.select(F.col("predicted_class").alias("label"), "n", "overall_rate", "safety_rate", "length_rate",
                        "mean_words", "median_words")


@query("weighted_quantiles_with_nulls", """
WITH e AS (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)
SELECT event_type, unnest([0.0, 0.5, 1.0]) AS prob, unnest(quantile_cont(value, [0.0, 0.5, 1.0])) AS quantile FROM e
GROUP BY event_type""", doubles="prob quantile")
def weighted_quantiles_with_nulls(spark, sf_dir):
    """Distinct values with counts; NULL and NaN among them are left out."""
    gone = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan")))
    value = F.when(F.col("event_id") % 5 != 0, F.col("value")).otherwise(gone)
    cells = I.table(spark, sf_dir, "events").groupBy("event_type", value.alias("value")).agg(F.count(F.lit(1)).alias("times"))
    return ranking.exact_quantiles(cells, ["event_type"], "value", [0.0, 0.5, 1.0], weight="times")


def _records_as_conversations(spark, sf_dir):
    rows = _classifier_records(spark, sf_dir)
    return preference.create_conversations(rows).withColumnRenamed("image_id", "conv_id")


@query("training_pairs", PAIRS_SQL + "," + PROMPTS_SQL + f"""
SELECT conv_id, md5(json_array(
         json_object('role', 'system', 'content', json_array(json_object('type', 'text', 'text', {_sql_text(preference.SYSTEM_MESSAGE)}))),
         json_object('role', 'user', 'content', json_array(
           json_object('type', 'image', 'image', '/img/' || conv_id || '.jpg'),
           json_object('type', 'image', 'image', '/img/' || conv_id || '_overlay.jpg'),
           json_object('type', 'text', 'text', user_text))))::VARCHAR) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected
FROM pairs JOIN prompts ON doc_id = conv_id""")
def training_pairs(spark, sf_dir):
    """Pairs with the system and user message of their record as JSON text."""
    metadata = I.document_records(spark, sf_dir).limit(0).select(F.col("image_id").alias("conv_id"), "predicted_class", "gradcam_spatial_region")
    built = curation.build_pairs(
        I.candidate_texts(spark, sf_dir), metadata, "conv_id", "turn", "teacher_reasoning", I.LEXICON,
        conversations=_records_as_conversations(spark, sf_dir))
    pairs = preference.training_pairs(built.where(F.col("prompt").isNotNull()).select("conv_id", "prompt", "chosen", "rejected"), carry=["conv_id"])
    return pairs.select("conv_id", *[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


LISTED_WORDS = ["the", "und", "que", "des", "con", "zzz"]
LISTED_SQL = BEST_SQL.replace("AS matched,", f"AS by_class, CASE WHEN conv_id % 2 = 0 THEN list_filter({I.sql_list(LISTED_WORDS)}, lambda x: contains(low, x)) ELSE by_class END AS matched,", 1)


@query("pairs_with_listed_keywords", LISTED_SQL + """
SELECT conv_id, hi / 100.0::DOUBLE AS chosen_score, lo / 100.0::DOUBLE AS rejected_score
FROM ends WHERE hi - lo >= 20""", doubles="chosen_score rejected_score")
def pairs_with_listed_keywords(spark, sf_dir):
    """A record's own keyword list wins over the list of its class when its answers are scored."""
    texts = I.candidate_texts(spark, sf_dir)
    listed = F.when(F.col("conv_id") % 2 == 0, F.array(*[F.lit(w) for w in LISTED_WORDS]))
    metadata = texts.select("conv_id", "predicted_class", "gradcam_spatial_region", listed.alias("expected_keywords"))
    answers = texts.select("conv_id", "turn", "teacher_reasoning")
    pairs = curation.build_pairs(answers, metadata, "conv_id", "turn", "teacher_reasoning", I.LEXICON)
    return pairs.select("conv_id", "chosen_score", "rejected_score")


RECORD_CLASSES = list(EXPECTED_KEYWORDS)
_record_scores = ", ".join(I.u(repr(c), "vec_id") for c in RECORD_CLASSES)
_record_words = ", ".join(I.sql_list(EXPECTED_KEYWORDS[c]) for c in RECORD_CLASSES)


@query("record_builder", f"""
WITH s AS (SELECT vec_id, label, [{_record_scores}] AS p FROM embeddings),
t AS (SELECT *, list_position(p, list_max(p)) AS k FROM s)
SELECT 'v' || vec_id AS image_id, {I.sql_list(RECORD_CLASSES)}[k] AS predicted_class, upper({I.sql_list(RECORD_CLASSES)}[k]) AS predicted_name,
       round(list_max(p), 4) AS confidence, round(p[1], 4) AS first_score, array_to_string([{_record_words}][k], ',') AS keywords,
       k = label % 7 + 1 AS cnn_correct, 'out/gradcam/v' || vec_id || '_overlay.jpg' AS overlay
FROM t""", doubles="confidence first_score")
def record_builder(spark, sf_dir):
    """Classifier records from scores and heat-map words, with the keywords of the predicted class."""
    classes = F.array(*[F.lit(c) for c in RECORD_CLASSES])
    scored = I.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_id"), F.lit("x.jpg").alias("image_path"),
        F.get(classes, (F.col("label") % 7).cast("int")).alias("ground_truth"),
        F.create_map(*[x for c in RECORD_CLASSES for x in (F.lit(c), uniform(c, F.col("vec_id")))]).alias("all_scores"),
        F.lit("center").alias("gradcam_spatial_region"), F.lit("strong").alias("gradcam_intensity"))
    records = preference.classifier_records(scored, {c: c.upper() for c in RECORD_CLASSES}, folder="out")
    return records.select(
        "image_id", "predicted_class", "predicted_name", "confidence", F.col("all_scores")[RECORD_CLASSES[0]].alias("first_score"),
        F.concat_ws(",", "expected_keywords").alias("keywords"), "cnn_correct", F.col("gradcam_overlay_path").alias("overlay"))
