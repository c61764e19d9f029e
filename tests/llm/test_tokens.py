import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, rows
from hypothesis import given, settings, strategies as st

from evenhand.llm.bpe import BLOCK_PIECES, Encoder, Lexicon, Vocabulary, compile_lexicon, decode, encode, write_lexicon
from evenhand.llm.registry import tokenizer_file
from evenhand.llm.texts import byte_groups, cut_at_spaces, split_words
from evenhand.llm.token_count import token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(tokenizer_file())


HARD = ["Hello, World's it's 12 don't \u00e9 E\u0301 \u00df \u0130 \u03a3\u03b1\u03c2 \u03a3\u0391\u03a3", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>",
        "\u00bd \u00b2 \u5317\u4eac \U0001F600x'LL 'll''s", "a\u00a0b\u0085c\u200bd\x1ce\u3000f", "\u0301 a", "\u212b \u0958 \ufb01 \u01c5", "'", "\x00", "<|", "x" * 500]


def test_counts_and_codes_equal_the_library(spark, docs, library):
    content = rows() + [(1000 + i, t, "en", "s0", 0) for i, t in enumerate(HARD)]
    table = documents(spark, content)
    want = sorted((i is None, i, len((t or "").encode()), library.encode(t or "", add_special_tokens=False).ids)
                  for i, t, *_ in content)
    counted = token_counts(table, tokenizer_file()).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in counted), key=str) == sorted(
        ((a, b, c, len(d)) for a, b, c, d in want), key=str)
    coded = decode(encode(table, tokenizer_file(), carry=("lang", "size")), tokenizer_file())
    expected = sorted(((a, b, d) for a, b, _, d in want), key=str)
    got = [(r, np.frombuffer(r.ids, "<u4").tolist()) for r in coded.collect()]
    assert sorted(((r.doc_id is None, r.doc_id, ids) for r, ids in got), key=str) == expected
    for r, ids in got:
        assert r["size"] == "own size" and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    arrays = encode(table, tokenizer_file(), carry=("text", "size"), packed=False, decoded="text").collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.ids) for r in arrays), key=str) == expected
    assert all(r.text == library.decode(r.ids, skip_special_tokens=False) and r["size"] == "own size" for r in arrays)
    again = decode(encode(table, tokenizer_file(), packed=False), tokenizer_file(), name="n_tokens").collect()
    assert all(r.n_tokens == library.decode(r.ids, skip_special_tokens=False) for r in again)
    del docs


def test_every_code_point_in_three_positions(vocab, library):
    """At the start of a word, after a letter and after a mark, over all of Unicode."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        texts = [f"{c}a{c}:{c} {c}" for c in points[at:at + 4096]]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for text, ids in zip(texts, want):
            words, _ = split_words(pa.array([text]))
            got = b"".join(vocab.encode_word(w) for w in words.to_pylist())
            assert np.frombuffer(got, "<u4").tolist() == ids, ascii(text)


@settings(max_examples=1000, deadline=None)
@given(st.text(max_size=30))
def test_any_text_is_merged_like_the_library(vocab, library, text):
    words, _ = split_words(pa.array([text]))
    ids = b"".join(vocab.encode_word(w) for w in words.to_pylist())
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc\u00e9", min_size=1, max_size=6), max_size=40), st.lists(st.text("abc\u00e9", max_size=7), max_size=20))
def test_automaton_finds_its_words_and_no_others(tmp_path_factory, words, others):
    words = sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())
    outputs = [[i, i + 1][:1 + i % 2] for i in range(len(words))]
    path = str(tmp_path_factory.mktemp("lexicon") / "file")
    write_lexicon(compile_lexicon([w.encode() for w in words], outputs), path)
    lexicon = Lexicon(path)
    asked = words + others
    ranks = lexicon.ranks(pa.array(asked, pa.string()))
    for word, rank in zip(asked, ranks.tolist()):
        assert (rank >= 0) == (word in words)
        if rank >= 0:
            assert lexicon.ids[lexicon.starts[rank]:lexicon.starts[rank + 1]].tolist() == outputs[words.index(word)]


def test_suffixes_are_shared():
    words = [a + b for a in (b"s", b"t", b"st") for b in (b"ing", b"ings", b"ed")]
    arrays = compile_lexicon(words, [[0]] * len(words))
    assert len(arrays["final"]) < 10


def test_pieces_never_cut_a_word():
    data = ("word " * 1000 + "x" * 5000 + " end").encode()
    cut = list(cut_at_spaces(data, 100))
    assert b"".join(cut) == data and b"".join(cut).split() == [w for c in cut for w in c.split()]
    texts = pa.array(["a b", None, "c " * 600, "", "d"])
    found = {}
    for at, group in byte_groups(texts, 100):
        words, place = split_words(group)
        for w, p in zip(words.to_pylist(), place.tolist()):
            found.setdefault(int(at[p]), []).append(w)
    assert found == {0: ["a", "b"], 2: ["c"] * 600, 4: ["d"]}


def test_empty_table(no_docs):
    assert token_counts(no_docs, tokenizer_file()).count() == 0
    assert decode(encode(no_docs, tokenizer_file()), tokenizer_file()).count() == 0


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexicon") / "file")
    write_lexicon(compile_lexicon([b"the", b"sea,"], [[1, 2, 3], [4]]), path)
    return Encoder(tokenizer_file(), Lexicon(path))


def ids_by_word(encoder, words):
    ids, starts, sizes = encoder.words(pa.array(words, pa.string()))
    return [ids[s:s + n].tolist() for s, n in zip(starts.tolist(), sizes.tolist())]


def test_distinct_pieces_of_a_batch_are_merged_side_by_side(encoder, library, monkeypatch):
    """Words that the lexicon lacks were merged one after the other, which took four fifths of the encoder's time."""
    one_by_one = []
    scalar = Vocabulary.merged
    monkeypatch.setattr(Vocabulary, "merged", lambda self, piece: one_by_one.append(piece) or scalar(self, piece))
    parts = ["tion", "ing", "An", "\u00e9", "\u00df", "st,", "9", "(x", "'s", "eau", "'", "\u5317"]
    words = [a + b + c for a in parts for b in parts for c in parts] + [f"{a}{i}" for a in ("thand", "oner") for i in range(BLOCK_PIECES)]
    words += ["".join(chr(97 + (i * k) % 26) for i in range(n)) for k in (1, 5, 11) for n in range(2, 90)]
    words = sorted(set(words))
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert ids_by_word(encoder, words) == want
    assert one_by_one and all(len(p) > 64 for p in one_by_one)


def test_words_of_a_batch_keep_their_places(encoder, library):
    words = [w for text in HARD for w in split_words(pa.array([text]))[0].to_pylist()]
    words += [chr(a) + chr(b) + "a" + chr(a) for a in range(128) for b in (33, 39, 48, 60, 65, 97, 127) if not chr(a).isspace() or a in range(28, 32)]
    words += ["<|endoftext|><|endoftext|>", "x<|startoftext|>'ll", "the", "sea,", "a<b", "'s's", "''re", "1.2e-3", "x" * 64, "y" * 65]
    want = [[1, 2, 3] if w == "the" else [4] if w == "sea," else library.encode(w, add_special_tokens=False).ids for w in words]
    assert ids_by_word(encoder, words) == want
    assert ids_by_word(encoder, words[::-1]) == want[::-1]
    assert ids_by_word(encoder, []) == [] and ids_by_word(encoder, ["the"]) == [[1, 2, 3]] and ids_by_word(encoder, ["\u00e9"]) == [
        library.encode("\u00e9", add_special_tokens=False).ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(min_size=1, max_size=12), st.text("abeEt'9,<|\u00e9", min_size=1, max_size=70)), max_size=30))
def test_any_words_of_a_batch_are_merged_like_the_library(vocab, library, texts):
    words = sorted(set(split_words(pa.array(texts, pa.string()))[0].to_pylist()))
    ids, starts, sizes = vocab.encode_words(pa.array(words, pa.string()))
    for word, start, size in zip(words, starts.tolist(), sizes.tolist()):
        assert ids[start:start + size].tolist() == library.encode(word, add_special_tokens=False).ids
