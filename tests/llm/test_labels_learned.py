import math
import random

import numpy as np
import pytest
from helpers import documents, rows
from pyspark.sql import functions as F

from evenhand.llm.language import identify, labelled_sample
from evenhand.llm.toxicity import NEAREST, BlockMaxIndex, Calibration, Rows, rising, score


def test_languages(spark, docs):
    labelled = docs.where(F.col("doc_id") < 150)
    got = identify(docs, labelled, carry=("size", "text")).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r.text or ""
        assert r["size"] == "own size" and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("de" if text.startswith("der") else "en")


def test_unseen_words_back_off_to_their_characters(spark):
    content = [(i, "schaften heiten ungen" if i % 2 else "nesses tions lings", "de" if i % 2 else "en", "s", 0) for i in range(20)]
    asked = documents(spark, [(1, "freundschaften", None, "s", 0), (2, "wildernesses", None, "s", 0), (3, "\u5317\u4eac", None, "s", 0)])
    got = {r.doc_id: r.lang_pred for r in identify(asked, documents(spark, content)).collect()}
    assert got[1] == "de" and got[2] == "en" and got[3] in ("de", "en")


def test_nothing_to_learn_from(spark, docs, no_docs):
    assert {r.lang_pred for r in identify(docs, no_docs).collect()} == {"und"}
    assert identify(no_docs, docs).count() == 0
    empty = no_docs.withColumn("toxic", F.lit(1))
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(no_docs, docs.withColumn("toxic", F.lit(0))).count() == 0


@pytest.mark.parametrize("dense", [0, 5, 40])
def test_block_max_search_is_exact(dense):
    rng = random.Random(3)
    vectors = []
    for _ in range(700):
        v = {rng.randrange(40): rng.choice([0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 6))}
        size = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / size for t, w in v.items()})
    as_rows = lambda vs: Rows(*map(np.array, zip(*[(i, t, v[t]) for i, v in enumerate(vs) for t in sorted(v)])))
    keys = [i // 2 for i in range(700)]
    index = BlockMaxIndex.build(lambda: iter([as_rows(vectors)]), [i % 3 == 0 for i in range(700)], keys, 40, dense)
    asked = vectors[::2]
    for without in (None, [keys[i] for i in range(0, 700, 2)]):
        found = index.nearest(as_rows(asked), len(asked), NEAREST, without)
        for place, (q, got) in enumerate(zip(asked, found)):
            cosines = [(round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)
                       if without is None or keys[i] != without[place]]
            want = sorted((-c, i) for c, i in cosines if c > 0)[:NEAREST]
            assert [(-s, int(index.place[i])) for s, i in got] == want


def plain_scores(texts, labels):
    """(score, three nearest) of each text by comparing it with all labelled ones; labels has None for the others."""
    words = [[w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()] for t in texts]
    examples = [i for i, y in enumerate(labels) if y is not None]
    n, ones = len(examples), sum(labels[i] for i in examples)
    p = ones / n

    def weight(w):
        having = [i for i in examples if w in words[i]]
        share = (sum(labels[i] for i in having) + 2 * p) / (len(having) + 2)
        raised = max(0.0, math.log(share / (1 - share)) - math.log(p / (1 - p))) if having else 0.0
        return (math.log((n + 1) / (len(having) + 1)) + 1) * (1 + 2 * raised)

    weights = {w: weight(w) for ws in words for w in set(ws)}
    vectors = []
    for ws in words:
        v = {w: (1 + math.log(ws.count(w))) * weights[w] for w in set(ws)}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / size for w, x in v.items()})

    def near(i, but):
        cosines = [(round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 12), j) for j in examples if j != but]
        return sorted((-c, j) for c, j in cosines if c > 0)[:NEAREST]

    def raw(found):
        return sum(labels[j] / (1.1 + c) for c, j in found) / sum(1 / (1.1 + c) for c, j in found) if found else None

    fitted = Calibration.of(*zip(*sorted(((raw(near(i, i)), labels[i]) for i in examples), key=lambda x: (x[0] is None, x))))
    return [(fitted.score(raw(near(i, None))), [j for _, j in near(i, None)[:3]]) for i in range(len(texts))]


def test_scores_equal_brute_force(spark):
    rng = random.Random(11)
    common, marks = [f"w{'abcdefgh'[i % 8]}{'xyzuv'[i % 5]}{'pqr'[i % 3]}" for i in range(60)], ["rotten", "vile", "foul"]
    texts, labels = [], []
    for i in range(260):
        text = rng.choices(common, k=rng.randrange(5, 40))
        if i % 7 == 0:
            text[1:3] = rng.choices(marks, k=2)
        texts.append(" ".join(text))
        labels.append(None if i % 5 == 0 else int(i % 7 == 0))
    texts += ["", None, "nothing shared here", texts[7], "Rotten, ROTTEN and foul"]
    labels += [None] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    known = docs.join(spark.createDataFrame([(i, y) for i, y in enumerate(labels) if y is not None], "doc_id long, toxic int"), "doc_id")
    got = {r.doc_id: r for r in score(docs, known).collect()}
    for i, (value, evidence) in enumerate(plain_scores(texts, labels)):
        assert got[i].score == pytest.approx(value, abs=1e-9) and got[i].evidence == evidence, i
    assert got[263].evidence[0] == 7 and got[264].predicted == 1 and got[260].evidence == got[262].evidence == []


def test_calibration_never_falls():
    rng = np.random.default_rng(1)
    values = rng.random(500)
    edges, chances = rising(values, (rng.random(500) < values).astype(float))
    assert (np.diff(edges) >= 0).all() and (np.diff(chances) >= 0).all()


def test_toxic_words_are_learned_with_evidence(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    content, labels = [], []
    for i in range(400):
        text = rng.choices(words, k=30)
        if i % 8 == 0:
            text[3:6] = rng.choices(["rotten", "rottenly", "vileness"], k=3)
        content.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(i % 8 == 0)))
    docs = documents(spark, content + [(900, "You ROTTEN, rotten thing", "en", "s", 0), (901, "a fine day", "en", "s", 0),
                                       (902, None, None, None, None), (902, None, None, None, None)])
    labelled = docs.join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id")
    got = score(docs, labelled).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 404 and by[900].predicted == 1 and by[901].predicted == 0 and by[902].predicted == 0
    assert all(e % 8 == 0 for e in by[900].evidence) and len(by[900].evidence) == 3 and "rotten" in by[900].terms
    wrong = sum(r.predicted != int(r.doc_id % 8 == 0) for r in got if r.doc_id < 400)
    assert wrong == 0


def test_marks_alone_are_no_letters(spark):
    content = [(i, "the sea and the thing", "en", "s", 1) for i in range(8)] + [(i, "der die und das", "de", "s", 1) for i in range(20, 28)]
    odd = [(100, "\u0301 \u0302\u0301", "en", "s", 1), (101, "\u0301the\u0301 sea", "en", "s", 1), (102, "\u0301 the sea", "en", "s", 1)]
    got = {r.doc_id: r for r in identify(documents(spark, content + odd), documents(spark, content)).collect()}
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0) and got[101].lang_pred == got[102].lang_pred == "en"


def test_small_languages_are_learned_whole(spark):
    common = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("the sea and the thing").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(100_000, 100_050).select(F.col("id").alias("doc_id"), F.lit("zorn blau wexel").alias("text"), F.lit("xx").alias("lang"))
    whole = common.union(rare)
    counts = {r.lang: r["count"] for r in labelled_sample(whole, "doc_id", "lang", 2_000).groupBy("lang").count().collect()}
    assert counts["xx"] == 50 and abs(counts["en"] - 1_950) < 200
    asked = spark.createDataFrame([(1, "blau zorn"), (2, "the thing")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(asked, whole, max_rows=2_000).collect()} == {1: "xx", 2: "en"}
