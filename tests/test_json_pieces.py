import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from evenhand.sources import json_pieces, tables
from evenhand.sources.json_pieces import cut_records, read_json_pieces, summary

SCHEMA = T.StructType().add("id", "long").add("text", "string").add(
    "parts", T.ArrayType(T.StructType().add("a", "long").add("b", "string")))
NASTY = ['}', '{', '"', '\\', '\\"', '\\\\"}', '],[', '} {', 'é \n', '']


def records(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(NASTY + ["word "]) for _ in range(rng.randrange(30)))
    return [{"id": i, "text": text(), "parts": [{"a": j, "b": text()} for j in range(rng.randrange(4))]} for i in range(n)]


def as_tuple(r):
    return r["id"], r["text"], tuple((p["a"], p["b"]) for p in r["parts"] or [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.text('ab"\\{}[]', max_size=4), st.one_of(
    st.text('ab"\\{}[] ,', max_size=8), st.lists(st.integers(), max_size=3), st.none()), max_size=3), max_size=5),
    st.integers(1, 12), st.booleans(), st.sampled_from([None, 1]))
def test_pieces_find_the_same_records(content, size, as_array, indent):
    """Pieces cut at every few closing braces; states carried over them by their summaries alone."""
    whole = json.dumps(content, indent=indent) if as_array else "\n".join(json.dumps(c) for c in content)
    cuts = whole.encode().split(b"}")
    pieces = [b"}".join(cuts[i:i + size]) + b"}" for i in range(0, len(cuts), size)]
    inside, depth, base, open_text, got = False, 0, int(as_array), b"", []
    for data in pieces:
        head, full, tail = cut_records(data, inside, depth, base)
        if head is not None:
            open_text += head
            if head != data or tail is not None or full:
                got.append(open_text)
                open_text = b""
            elif json_pieces.nesting(open_text)[1].size and _closed(open_text):
                got.append(open_text)
                open_text = b""
        got += full
        open_text = tail if tail is not None else open_text
        flips, out, within, low_out, low_in = summary(data)
        depth += within if inside else out
        inside ^= bool(flips)
        assert min(low_out, low_in) <= 0
    assert [json.loads(g) for g in got if g.startswith(b"{")] == content


def _closed(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_in_many_tasks(spark, tmp_path, indent):
    rows = records(400)
    (tmp_path / "one.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    read = read_json_pieces(spark, str(tmp_path / "one.json"), SCHEMA, split_bytes=4_096, piece_bytes=500)
    assert sorted(as_tuple(r) for r in read.collect()) == [as_tuple(r) for r in rows]
    pieces = json_pieces.text_pieces(spark, str(tmp_path / "one.json"), 4_096, 500)
    assert pieces.select("start").distinct().count() > 5
    assert pieces.where(F.col("is_array").isNotNull()).count() == 1
    plain = tables.read_json_array(spark, str(tmp_path / "one.json"), SCHEMA)
    assert sorted(as_tuple(r) for r in plain.collect()) == sorted(as_tuple(r) for r in read.collect())


def test_many_splits_are_few_tasks(spark, tmp_path):
    """Splits stay byte ranges of their own, but thousands of them are no thousands of tasks and files."""
    rows = records(400)
    (tmp_path / "one.json").write_text(json.dumps(rows), encoding="utf-8")
    pieces = json_pieces.text_pieces(spark, str(tmp_path / "one.json"), 256, 500)
    assert pieces.select("start").distinct().count() > 100
    assert len(pieces.inputFiles()) <= spark.sparkContext.defaultParallelism
    read = read_json_pieces(spark, str(tmp_path / "one.json"), SCHEMA, split_bytes=256, piece_bytes=500)
    assert sorted(as_tuple(r) for r in read.collect()) == [as_tuple(r) for r in rows]
    assert [json_pieces.task_count(n, 64 << 10, 12) for n in (0, 5, 600, 16_000, 96_000)] == [1, 5, 12, 63, 375]


def test_records_longer_than_pieces_and_splits(spark, tmp_path):
    rows = [{"id": i, "text": "}{" * 5_000 * i, "parts": [{"a": j, "b": "}"} for j in range(300)]} for i in range(6)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 77, "text": None, "parts": None}]))
    read = read_json_pieces(spark, str(tmp_path), SCHEMA, split_bytes=4_096, piece_bytes=100)
    assert sorted(as_tuple(r) for r in read.collect()) == [as_tuple(r) for r in rows] + [(77, None, ())]


@pytest.mark.parametrize("text,ids", [
    ("[]", []), ("", []), (" \n[ ] \n", []), ('{"id": 5}', [5]), ('{"id": 5}\n{"id": 6}\n', [5, 6]),
    ('[1, "a}", [2, {"id": 8}], {"id": 9}, null]', [9]), ('﻿[{"id": 3}]', [3]), ('[{"id": "no number"}]', [None]),
    ('[[[{"id": 1}], [{"id": 2}]], {"id": 4}]', [4]),
])
def test_other_contents(spark, tmp_path, text, ids):
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    for piece in (1, 10_000):
        read = read_json_pieces(spark, str(tmp_path / "x.json"), SCHEMA, piece_bytes=piece)
        assert sorted((r["id"] for r in read.collect()), key=str) == ids


def test_the_setting_of_the_session_stays(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "x.json").write_text("[]")
    read_json_pieces(spark, str(tmp_path / "x.json"), SCHEMA, split_bytes=4_096)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
