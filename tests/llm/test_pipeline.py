import hashlib
import itertools
import pathlib

import corpus_pipeline
import pytest
from helpers import CLASHING, documents, rows
from pyspark.sql import functions as F
from test_near_copies import united
from test_near_texts import alike, plain_set

from evenhand.llm.mixing import mix
from evenhand.llm.queries import QUERIES, SQL
from evenhand.llm.registry import table, tokenizer_file
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows after each stage on the smallest tables."""
    docs = table(spark, sf_dir, "documents")
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.reliable_checkpoint(stage(spark, docs, sf_dir), "test")
        found.append(docs.collect())
    return found


def test_filters_drop_rows_and_keep_the_rest_as_it_is(spark, sf_dir, stages):
    first, known, clean, single, _, _ = stages
    whole = {r.doc_id: r for r in first}
    for kept in (known, clean, single):
        assert all(whole[r.doc_id] == r for r in kept) and len({r.doc_id for r in kept}) == len(kept)
    assert all(any(c.isalpha() for c in r.text) for r in known)
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    gone = {r.doc_id for r in known} - {r.doc_id for r in clean}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(known)


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir):
    larger = str(pathlib.Path(sf_dir).parent / "sf0.01")  # the smallest tables have nine toxic documents to learn from
    docs = table(spark, larger, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, larger).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - kept
    toxic = [i for i, y in labels.items() if y == 1]
    assert len(gone & set(toxic)) >= 0.7 * len(toxic)
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)


def test_one_of_each_group_stays(stages):
    """Of all documents that reach each other by links of 0.8 or more the one of the smallest number stays."""
    clean, single = stages[2], stages[3]
    sets = {r.doc_id: plain_set(r.text) for r in clean}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] == sets[b] or alike(sets[a], sets[b])]
    assert {r.doc_id for r in single} == set(united(sorted(sets), links).values()) and len(single) < len(clean)


def test_mix_and_tokens(stages):
    from tokenizers import Tokenizer

    single, mixed, coded = stages[3:]
    whole = {r.doc_id: r for r in single}
    assert all(whole[r.doc_id] == r for r in mixed)
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert 0.7 < words(mixed) / words(single) < 1.3
    library = Tokenizer.from_file(tokenizer_file())
    digest = lambda ids: hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    want = sorted((r.doc_id, r.lang, r.source, ids, digest(ids)) for r in mixed
                  for ids in [library.encode(r.text, add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.lang, r.source, r.token_ids, r.decoded_sha256) for r in coded) == want
    assert all(r.n_tokens == len(r.token_ids) for r in coded)


def test_run_takes_all_stages(spark, sf_dir, stages):
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(stages[-1])


#: Every name that an operator or a stage gives to a column of its own.
MADE = CLASHING + [
    "lang_pred", "predicted", "evidence", "terms", "source_size", "token_ids", "decoded", "decoded_sha256", "fingerprint",
    "component_id", "root", "least", "_src", "_hash", "_class", "_slice", "_at", "_before", "_rate", "_offset", "_copy",
    "_bits", "_root", "cluster", "part", "parts", "own", "c_text", "c_doc_id", "number of the copy", "own column 3"]


def test_awkward_documents_keep_their_own_columns(spark, sf_dir):
    docs = documents(spark, extra=False).withColumns({c: F.lit(f"own {c}") for c in MADE})
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.reliable_checkpoint(stage(spark, docs, sf_dir), "test")
        if name != "bpe":
            assert docs.columns == columns
            kept = docs.select(*[f"`{c}`" for c in MADE]).distinct().collect()
            assert [r.asDict() for r in kept] == [{c: f"own {c}" for c in MADE}]
    got = docs.collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in rows()} and 200 not in {r.doc_id for r in got}


def test_mix_keeps_all_but_its_results(spark):
    docs = documents(spark, extra=False).withColumns({c: F.lit(f"own {c}") for c in MADE})
    mixed = mix(docs)
    others = [c for c in MADE if c not in ("size", "source_size", "target", "copies", "taken")]
    assert [r.asDict() for r in mixed.select(*[f"`{c}`" for c in others]).distinct().collect()] == [{c: f"own {c}" for c in others}]
    assert mixed.schema["copies"].dataType.simpleString() == "int"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    text, _, ok = compare(spark, connect(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op13_hard_negatives"}))
def test_every_row_has_a_result(spark, sf_dir, name):
    of = {"op2": "pages", "op6": "embeddings", "op8": None}.get(name.split("_")[0], "documents")
    n = QUERIES[name](spark, sf_dir).count()
    if of is None:
        asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).count()
        assert n == 20 * asked
    else:
        assert n == table(spark, sf_dir, of).count()
