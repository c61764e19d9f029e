"""BPE encoding and decoding with a transducer of frequent words.

The words of all documents are counted; the frequent ones are encoded once and
compiled into a minimal acyclic automaton over their bytes. Equal suffixes are
shared; each arc carries the number of words that sort before it, so a walk adds up
to the word's rank, and the rank points to the word's ids. The flat arrays are one
file, sent with ``addFile`` and memory-mapped by the workers of an executor. Words
that the automaton lacks are merged exactly, pair by pair, in the order of ranks,
all distinct pre-tokens of a batch at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.texts import KEEPERS, bounded_batches, byte_groups, coded_words, gather, lean, word_counts
from evenhand.session import reliable_checkpoint

FREQUENT_WORDS = 1 << 17  # bound on the lexicon: words that make up 1 / FREQUENT_WORDS of all words or more
KNOWN_PIECES = 1 << 17  # merged pre-tokens kept from word to word where words are encoded one by one
BATCH_BYTES = 1 << 20  # of texts that a worker encodes together
KEPT_LENGTH = 64  # bytes of the longest pre-token that is kept or merged beside others, which bounds both in bytes
BLOCK_PIECES = 1 << 12  # pre-tokens merged side by side

# Fixed values of the vocabulary's format: the pre-tokenizer's pattern for ASCII and the mark of a word's end.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D a-z0-9]+"
WORD_END = "</w>"
PLAIN = "^[!-&(-;=-~]+$"  # words of printable ASCII without the beginnings of contractions and special strings
DIGIT, LETTER = 1, 2
KINDS = np.array([DIGIT if chr(b) in "0123456789" else LETTER if chr(b).islower() else 0 for b in range(128)], np.int8)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Merges:
    """The merges (left id, right id, made id) in the order of their ranks, for many pre-tokens side by side."""

    PLACES = KEPT_LENGTH.bit_length()  # bits of a position in a pre-token
    NONE = np.iinfo(np.int32).max

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        left, right, self.made = np.array(merges, np.int64).reshape(-1, 3).T.copy()
        self.made = self.made.astype(np.int32)
        keys = left << 32 | right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.rank = (self.rank << self.PLACES).astype(np.int32)

    def due(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and position ``at`` of each pair as one number, so that the smallest is the leftmost of the lowest rank."""
        if not len(self.keys):
            return np.full(len(left), self.NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.rank[found] | at, self.NONE).astype(np.int32)

    def merged(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, how many each has); a pre-token is the run ``symbols[start:start + size]``, at most KEPT_LENGTH long.

        A column for each pre-token, a row for each position. Every round merges in every
        column the leftmost pair of the lowest rank; columns without one are done. The row
        below the last position stands for what is before the first symbol and after the last.
        """
        n, wide = len(sizes), int(sizes.max(initial=0))
        place = np.arange(wide + 1)[:, None]
        symbol = np.where(place < sizes, symbols[np.minimum(starts + place, len(symbols) - 1)], -1).astype(np.int32)
        after = np.where(place + 1 < sizes, place + 1, wide).astype(np.int16)
        before = np.where(place > 0, place - 1, wide).astype(np.int16) + np.zeros((1, n), np.int16)
        due = np.full((wide + 1, n), self.NONE, np.int32)
        row, column = np.nonzero(place + 1 < sizes)
        due[row, column] = self.due(symbol[row, column], symbol[row + 1, column], row)
        while True:
            best = due.min(axis=0, initial=self.NONE)
            column = np.flatnonzero(best < self.NONE)
            if not len(column):
                break
            best = best[column]
            row = best & (1 << self.PLACES) - 1
            right = after[row, column]
            follows, precedes = after[right, column], before[row, column]
            made = self.made[best >> self.PLACES]
            symbol[row, column], symbol[right, column] = made, -1
            after[row, column], before[follows, column] = follows, row
            due[right, column] = self.NONE
            due[row, column] = self.due(made, symbol[follows, column], row)
            due[precedes, column] = self.due(symbol[precedes, column], made, precedes)
        left = symbol.T[symbol.T >= 0]
        return left.astype("<u4"), np.count_nonzero(symbol >= 0, axis=0)


def plain_pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of the words one after the other, how many each word has) of lower-cased words that match PLAIN.

    A pre-token is a run of letters, one digit, or a run of other characters.
    """
    text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], pc.ascii_lower(words)), "")[0].as_py().encode()
    kind = KINDS[np.frombuffer(text, np.uint8)]
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.ones(len(kind) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first[ends] = True
    starts = np.flatnonzero(first)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(text))
    return pieces, np.diff(np.searchsorted(starts, ends), prepend=0)


class Vocabulary:
    """Ids, merge ranks and token strings of a word BPE file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        # The library's own view of characters, without its copy of the vocabulary.
        rules = content | {"model": content["model"] | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        library = Tokenizer.from_str(json.dumps(rules))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids: dict[str, int] = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.rank = {tuple(pair): i for i, pair in enumerate(content["model"]["merges"])}
        self.merges = Merges([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.rank])
        names = self.ids | self.special
        self.tokens = [""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token
        self.symbols = byte_symbols()
        self.inner, self.last = np.zeros((2, 1 + max(map(ord, self.symbols))), np.int32)  # ids of byte symbols by code point
        for symbol in self.symbols:
            self.inner[ord(symbol)], self.last[ord(symbol)] = self.ids[symbol], self.ids[symbol + WORD_END]
        self.ascii = str.maketrans({b: self.symbols[b] for b in range(128)})
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, bytes] = {}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def merged(self, piece: str) -> bytes:
        """Packed ids of one pre-token in byte symbols: the leftmost pair of the lowest rank is merged until none is left."""
        rank, none = self.rank.get, 1 << 40
        parts = list(piece)
        parts[-1] += WORD_END
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return np.array([self.ids[p] for p in parts], "<u4").tobytes()

    def encode_piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token; merged ones are kept for the next time."""
        if len(piece) > KEPT_LENGTH:
            return self.merged(piece)
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            found = self.known[piece] = self.merged(piece)
        return found

    def split(self, word: str) -> list[str]:
        """Special strings of a text without ASCII white space and the pre-tokens, in byte symbols, of the rest.

        Letters, numbers, lower case and composition of other than ASCII characters are
        the library's own, by its normalizer and its pre-tokenizer: its tables of
        characters are not those of Python.
        """
        found = []
        for i, part in enumerate(self.marks.split(word) if "<|" in word else [word]):
            if i % 2:
                found.append(part)
            elif part.isascii():
                lowered = part.lower()
                if lowered.isalpha():
                    found.append(lowered)
                else:
                    found += [p.translate(self.ascii) for p in self.pieces.findall(lowered)]
            else:
                found += [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return found

    def encode_word(self, word: str) -> bytes:
        """Packed ids of a text without ASCII white space."""
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.encode_piece(p)
                        for p in self.split(word))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word start, how many it has): what :meth:`encode_word` gives for each."""
        plain = pc.match_substring_regex(words, PLAIN)
        found, each = plain_pieces(words.filter(plain))
        split = [self.split(w) for w in words.filter(pc.invert(plain)).to_pylist()]
        found = pa.concat_arrays([found, pa.array([p for s in split for p in s], pa.string())]).dictionary_encode()
        ids, starts, sizes = self.encode_pieces(found.dictionary)
        codes = found.indices.to_numpy()
        ids = gather(ids, starts[codes], sizes[codes])
        sums = np.concatenate([[0], np.cumsum(sizes[codes])])
        ends = np.cumsum(np.concatenate([each, np.fromiter(map(len, split), np.int64, len(split))]))
        ends = sums[np.concatenate([[0], ends])]
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        starts, sizes = np.empty_like(order), np.empty_like(order)
        starts[order], sizes[order] = ends[:-1], np.diff(ends)
        return ids, starts, sizes

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece start, how many it has) of distinct pieces; similar lengths are merged side by side."""
        lengths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths[pc.is_in(pieces, pa.array(list(self.special), pa.string())).to_numpy(zero_copy_only=False)] = KEPT_LENGTH + 1
        order = np.argsort(lengths, kind="stable")
        beside, apart = np.split(order, [np.searchsorted(lengths[order], KEPT_LENGTH, "right")])
        found, sizes = [np.zeros(0, "<u4")], np.zeros(len(pieces), np.int64)
        for first in range(0, len(beside), BLOCK_PIECES):
            block = beside[first:first + BLOCK_PIECES]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(block)], pieces.take(pa.array(block))), "")[0].as_py()
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            ends = np.cumsum(lengths[block])
            symbols = self.inner[points]
            symbols[ends - 1] = self.last[points[ends - 1]]
            ids, sizes[block] = self.merges.merged(symbols, ends - lengths[block], lengths[block])
            found.append(ids)
        for i, piece in zip(apart, pieces.take(pa.array(apart)).to_pylist()):
            found.append(np.frombuffer(self.encode_word(piece) if piece in self.special else self.merged(piece), "<u4"))
            sizes[i] = len(found[-1])
        starts = np.empty_like(sizes)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(found), starts, sizes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


KEEPERS["bpe"] = vocabulary.cache_clear


# --- the automaton ----------------------------------------------------------


def compile_lexicon(words: Sequence[bytes], outputs: Sequence[Sequence[int]]) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal automaton of ``words`` with their outputs.

    ``words`` must be distinct; they are sorted here. Built word by word: the suffix
    of the previous word that the new one does not share is frozen, and frozen states
    that are alike are one state.
    """
    order = sorted(range(len(words)), key=lambda i: words[i])
    frozen: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # (final, ((byte, state), ...)) by state

    def freeze(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in frozen:
            frozen[shape] = len(arcs_of)
            arcs_of.append(shape)
        return frozen[shape]

    path = [[False, []]]  # open states along the last word: [final, arcs]
    last = b""
    for word in (words[i] for i in order):
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])

    below = [0] * len(arcs_of)  # words that can be read from a state; children have smaller numbers
    keys, target, before = [], [], []
    for state, (final, arcs) in enumerate(arcs_of):
        n = int(final)
        for byte, to in arcs:
            keys.append(state << 8 | byte)
            target.append(to)
            before.append(n)
            n += below[to]
        below[state] = n
    sizes = np.array([len(outputs[i]) for i in order], np.int64)
    flat = [x for i in order for x in outputs[i]]
    return {
        "root": np.array([root], np.int64), "final": np.array([f for f, _ in arcs_of], np.int64),
        "keys": np.array(keys, np.int64), "target": np.array(target, np.int64), "before": np.array(before, np.int64),
        "starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), "ids": np.array(flat, np.int64),
    }


def write_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the number of entries of each array, then the arrays, all as 64-bit integers."""
    with open(path, "wb") as file:
        np.array([len(a) for a in arrays.values()], np.int64).tofile(file)
        for a in arrays.values():
            a.astype(np.int64).tofile(file)


class Lexicon:
    """A memory-mapped automaton."""

    FIELDS = ("root", "final", "keys", "target", "before", "starts", "ids")

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        at = len(self.FIELDS)
        for field, size in zip(self.FIELDS, whole[:at]):
            setattr(self, field, whole[at:at + size])
            at += size

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Rank of each word among the words of the lexicon, -1 for others; one step walks all words by a byte."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return found
        words = words.cast(pa.binary())
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words)].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        live = np.arange(len(words))
        state = np.full(len(words), self.root[0], np.int64)
        rank = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = sizes[live] == step
            ended = done & (self.final[state] == 1)
            found[live[ended]] = rank[ended]
            live, state, rank = live[~done], state[~done], rank[~done]
            if not len(live):
                break
            key = state << 8 | data[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            live, rank, state = live[known], rank[known] + self.before[at[known]], self.target[at[known]]
            step += 1
        return found


def frequent_words(docs: DataFrame, text: str = "text", bound: int = FREQUENT_WORDS) -> list[str]:
    """Words that are at least 1 / ``bound`` of all words: at most ``bound`` of them, whatever the input."""
    counts = reliable_checkpoint(word_counts(docs, text), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.word for r in counts.where(F.col("n") * bound >= total).select("word").collect()]


def publish_lexicon(docs: DataFrame, tokenizer_file: str, text: str = "text", bound: int = FREQUENT_WORDS) -> str:
    """Compile the frequent words of ``docs`` and send the file to all executors; returns its name there."""
    vocab = vocabulary(tokenizer_file)
    words = frequent_words(docs, text, bound)
    arrays = compile_lexicon([w.encode() for w in words], [np.frombuffer(vocab.encode_word(w), "<u4") for w in words])
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = f"{folder}/lexicon"
    write_lexicon(arrays, path)
    with open(path, "rb") as file:
        name = f"lexicon-{hashlib.sha256(file.read()).hexdigest()[:24]}-{os.path.basename(folder)}.bin"
    os.rename(path, f"{folder}/{name}")
    docs.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


# --- encoding ---------------------------------------------------------------


class Encoder:
    """Encodes distinct words: ranks in the lexicon, exact merges for the rest."""

    def __init__(self, tokenizer_file: str, lexicon: Lexicon):
        self.vocab = vocabulary(tokenizer_file)
        self.lexicon = lexicon
        self.listed = lexicon.ids.astype("<u4")

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words one after the other, where each word's ids start, how many there are)."""
        lex = self.lexicon
        rank = lex.ranks(words)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen = rank >= 0
        starts[seen] = lex.starts[rank[seen]]
        sizes[seen] = lex.starts[rank[seen] + 1] - starts[seen]
        merged, starts[~seen], sizes[~seen] = self.vocab.encode_words(words.filter(pa.array(~seen)))
        starts[~seen] += len(self.listed)
        return np.concatenate([self.listed, merged]), starts, sizes


def encode(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text",
           bound: int = FREQUENT_WORDS, carry: Sequence[str] = (), packed: bool = True, decoded: str | None = None) -> DataFrame:
    """(key, carry..., n_tokens, ids): the ids of every whole text.

    ``ids`` are packed little-endian 32-bit integers or, with ``packed=False``, an array.
    ``decoded`` names a further column for the text that :func:`decode` makes of them.

    ``tokenizer_file`` is a word BPE file that all machines have. Equal to the library's
    encoding without added special tokens; special strings inside a text become their
    tokens. A null or empty text has no tokens and empty ``ids``; repeated rows are
    encoded one by one; an empty table gives an empty table; only ``key``, ``text`` and
    the columns of ``carry`` are read, so other names cannot clash; a carried column
    named ``n_tokens``, ``ids`` or ``decoded`` is replaced.
    """
    made = {"n_tokens": "long", "ids": "binary" if packed else "array<int>"} | ({decoded: "string"} if decoded else {})
    carry = [c for c in carry if c != key and c not in made]
    name = publish_lexicon(docs, tokenizer_file, text, bound)
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    narrow = docs.select(F.col(text).alias("_text"), F.col(key).alias(f"c_{key}"),
                         *[F.col(c).alias(f"c_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file, Lexicon(SparkFiles.get(name)))
        spaced = spaced_tokens(tokenizer_file) if decoded else None
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            parts: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for rows, group in byte_groups(batch.column(0)):
                words, codes, at = coded_words(group)
                ids, starts, sizes = encoder.words(words)
                flat = gather(ids, starts[codes], sizes[codes])
                each = np.bincount(at, weights=sizes[codes], minlength=len(rows)).astype(np.int64)
                ends = np.cumsum(each)
                np.add.at(n, rows, each)
                for row, end, size in zip(rows.tolist(), ends.tolist(), each.tolist()):
                    parts[row].append(flat[end - size:end].tobytes())
            each = [b"".join(p) for p in parts]
            if packed:
                joined = pa.array(each, pa.binary())
            else:
                whole = np.frombuffer(b"".join(each), "<u4").astype(np.int32)
                joined = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(whole))
            texts = [pa.array([text_of(np.frombuffer(e, "<u4"), spaced) for e in each], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), joined, *texts],
                                             [*batch.schema.names[1:], *made])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]] + [f"`{c}` {k}" for c, k in made.items()]
    return narrow.mapInArrow(lean(run, "bpe"), ", ".join(kinds)).toDF(key, *carry, *made)


def spaced_tokens(tokenizer_file: str) -> pa.Array:
    """Every token after a space."""
    return pa.array([" " + t for t in vocabulary(tokenizer_file).tokens], pa.large_string())


def text_of(ids: np.ndarray, spaced: pa.Array) -> str:
    """The tokens of ``ids``, joined with a space."""
    if not len(ids):
        return ""
    tokens = pc.take(spaced, pa.array(ids))
    start, end = (int.from_bytes(tokens.buffers()[1][8 * i:8 * i + 8].to_pybytes(), "little") for i in (0, len(tokens)))
    return tokens.buffers()[2][start + 1:end].to_pybytes().decode()


def decode(encoded: DataFrame, tokenizer_file: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``: the tokens of ``ids``, joined with a space as the library's decode does.

    ``ids`` are packed or an array, as :func:`encode` gives them. The vocabulary file names
    no decoder, so tokens keep their word-end marks. Empty or null ``ids`` give an empty
    text; a column that is called ``name`` already is replaced.
    """
    bounded_batches(encoded.sparkSession, BATCH_BYTES)
    encoded = encoded if name == ids else encoded.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = spaced_tokens(tokenizer_file)
        for batch in batches:
            texts: list[str] = []
            for value in batch.column(batch.schema.get_field_index(ids)):
                if not value.is_valid:
                    numbers = np.zeros(0, np.int64)
                elif pa.types.is_list(value.type):
                    numbers = value.values.to_numpy(zero_copy_only=False)
                else:
                    numbers = np.frombuffer(value.as_buffer(), "<u4")
                texts.append(text_of(numbers, spaced))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lean(run, "bpe"), f"{kinds}, `{name}` string")
