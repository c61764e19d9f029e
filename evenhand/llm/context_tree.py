"""Language model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of its own: its nodes are the
0 to 5 bytes before. A node estimates its decision by Krichevsky-Trofimov counts;
node and deeper nodes are mixed, half by half, over all depths by how well each
would have coded the training texts. The counts are those of 6-byte strings of all
training texts, summed by Spark.

The strings are the whole model. Contexts that share their last three bytes are one
group, and a task builds the nodes of its groups from their strings, so no level of the
tree is written. It hands up sums for the few contexts of two bytes, from which the top
of the tree is computed, and then gives the log probabilities of its most frequent
strings, which are sent to all workers. The strings of a text that are not among these
are passed on with the text's number, meet the tree of their group in such a task, and
are added back to their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.texts import GROUP_BYTES, bounded_batches, byte_groups, coded_words, cut_at_spaces, word_counts
from evenhand.session import reliable_checkpoint

DEPTH = 5  # bytes of the longest context
END = b"\xff"  # never part of UTF-8: the end of a text, and what stands before its first byte
SENT_STRINGS = 1 << 20  # bound on the strings whose log probability is sent to the workers
WORD_SHARE = 1 << 17  # a word's count is sent, if it is 1 / WORD_SHARE of all training words
TOP = 2  # contexts of so many bytes or fewer are the top of the tree; the others are grouped by their last TOP + 1 bytes
SLOT_STRINGS = 250_000  # strings of the training texts, and strings asked for, of a task
KNOWN_STRINGS = 1 << 21  # distinct strings that a task counts before it passes them on
LN2 = float(np.log(2))


# --- strings of bytes --------------------------------------------------------


def normal(data: bytes) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join(data.lower().split())


def pieces(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, list[tuple[bytes, bytes]]]]:
    """Groups of (row numbers, (context, bytes)); a text of more than ``limit`` bytes comes in several pieces."""
    rows: list[int] = []
    parts: list[tuple[bytes, bytes]] = []
    total = 0
    for row, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        context = END * DEPTH
        cuts = list(cut_at_spaces(data, limit)) if len(data) > limit else [data]
        started = False
        for i, cut in enumerate(cuts):
            body = normal(cut)
            if started and body:
                body = b" " + body
            started = started or bool(body)
            if i == len(cuts) - 1:
                body += END
            rows.append(row)
            parts.append((context, body))
            context = (context + body)[-DEPTH:]
            total += len(body) + DEPTH
            if total >= limit:
                yield np.array(rows), parts
                rows, parts, total = [], [], 0
    if rows:
        yield np.array(rows), parts


def strings(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(string of each byte with its context, number of bytes of each part); the byte itself is lowest."""
    data = np.frombuffer(b"".join(c + b for c, b in parts), np.uint8)
    sizes = np.array([len(b) for _, b in parts], np.int64)
    starts = np.cumsum(sizes + DEPTH) - sizes
    found = data.astype(np.uint64)
    for j in range(1, DEPTH + 1):
        found[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    body = np.ones(len(data), bool)
    for j in range(DEPTH):
        body[starts - 1 - j] = False
    return found[body], sizes


def string_counts(docs: DataFrame) -> DataFrame:
    """(string, n) over all texts of the one column of ``docs``, counted per task before the shuffle."""
    bounded_batches(docs.sparkSession)

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        return values[starts], np.add.reduceat(counts, starts)

    def table(values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["string", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, parts in pieces(batch.column(0)):
                values, counts = np.unique(strings(parts)[0], return_counts=True)
                held.append((values, counts.astype(np.int64)))
            if sum(len(v) for v, _ in held) > KNOWN_STRINGS:
                held = [merged(held)]
                if len(held[0][0]) > KNOWN_STRINGS:  # more distinct strings than fit: passed on as they are
                    yield table(*held.pop())
        if held:
            yield table(*merged(held))

    return docs.mapInArrow(run, "string long, n long").groupBy("string").agg(F.sum("n").alias("n"))


# --- the tree ----------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 by Stirling's series at x + 7."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    product = x.copy()
    for i in range(1, 7):
        product = product * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives to ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def summed(nodes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nodes in rising order, sum of each column by node)."""
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, np.int64)
    return nodes[starts], *[np.add.reduceat(c[order], starts) if len(nodes) else c for c in columns]


def decisions(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of contexts of DEPTH bytes, from distinct strings and their numbers.

    ``node`` is the context with the decision below it: 1, then the bits decided so far.
    """
    byte, context, j = values & 255, values >> 8, np.arange(8)
    node = (context[:, None] << 8) | (1 << j) | (byte[:, None] >> (8 - j))
    ones = ((byte[:, None] >> (7 - j)) & 1).ravel() == 1
    each = np.repeat(n.astype(np.float64), 8)
    return summed(node.ravel(), np.where(ones, 0, each), np.where(ones, each, 0))


def mixed(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of a node mixed with those below it, weight of its own estimate)."""
    own = log_estimate(a, b)
    return np.logaddexp(below, own) - LN2, 1 / (1 + np.exp(np.minimum(below - own, 700.0)))


def lower_levels(values: np.ndarray, n: np.ndarray) -> tuple[list[tuple], tuple]:
    """Levels TOP + 1 to DEPTH of (node, a, b, share), and (node, a, b, below) summed for level TOP.

    ``share`` is the weight of a node's own estimate, 1 for leaves. The strings must be
    all those whose contexts share their last TOP + 1 bytes with one of them.
    """
    node, a, b = decisions(values, n)
    weighted, share = log_estimate(a, b), np.ones(len(node))
    levels = []
    for depth in range(DEPTH, TOP, -1):
        levels.insert(0, (node, a, b, share))
        node, a, b, weighted = summed(node & ((1 << (8 * depth)) - 1), a, b, weighted)
        if depth - 1 > TOP:
            weighted, share = mixed(a, b, weighted)
    return levels, (node, a, b, weighted)


def place(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray, depth: int,
          above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[tuple, tuple]:
    """((nodes in rising order, probability of a one), what the next depth needs) of nodes whose parents are ``above``.

    A path through the tree mixes the estimates from the root down; ``sofar`` is what
    the shorter contexts give and ``left`` the weight that remains for longer ones.
    """
    one = (b + 0.5) / (a + b + 1)
    sofar, left = np.zeros(len(nodes)), np.ones(len(nodes))
    if above is not None and len(nodes):
        at = np.searchsorted(above[0], nodes & ((1 << (8 * depth)) - 1))
        sofar, left = above[1][at], above[2][at]
    p = np.clip(sofar + left * one, 1e-12, 1 - 1e-12).astype(np.float32)
    return (nodes, p), (nodes, sofar + left * share * one, left * (1 - share))


def top_tables(node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[list[tuple], tuple | None]:
    """(by depth 0 to TOP the nodes and their probabilities, state for the nodes below) from the sums of level TOP."""
    levels = []
    for depth in range(TOP, -1, -1):
        node, a, b, below = summed(node & ((1 << (8 * (depth + 1))) - 1), a, b, below)
        weighted, share = mixed(a, b, below)
        levels.insert(0, (node, a, b, share))
        below = weighted
    tables, above = [], None
    for depth, level in enumerate(levels):
        table, above = place(*level, depth, above)
        tables.append(table)
    return tables, above


class Coder:
    """Log2 probabilities of strings by the top of the tree and the levels below for their groups of contexts."""

    def __init__(self, top: tuple[list[tuple], tuple | None], levels: list[tuple]):
        self.tables, above = list(top[0]), top[1]
        for depth, level in enumerate(levels, TOP + 1):
            table, above = place(*level, depth, above)
            self.tables.append(table)

    def logs_of(self, values: np.ndarray) -> np.ndarray:
        """Eight decisions for each string, each by the deepest node there is."""
        return np.concatenate([np.zeros(0), *[self._some(values[i:i + 65_536]) for i in range(0, len(values), 65_536)]])

    def _some(self, values: np.ndarray) -> np.ndarray:
        values = values.view(np.int64)
        byte, context = values & 255, values >> 8
        j = np.arange(8)
        decision = (1 << j) | (byte[:, None] >> (8 - j))
        p = np.full(decision.shape, 0.5, np.float64)
        at, column = (x.ravel() for x in np.indices(decision.shape))
        decision = decision.ravel()
        for depth, (nodes, ones) in enumerate(self.tables):
            if not len(nodes) or not len(at):
                break
            node = (context[at] & ((1 << (8 * depth)) - 1)) << 8 | decision
            place = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            there = nodes[place] == node
            at, column, decision, place = at[there], column[there], decision[there], place[there]
            p[at, column] = ones[place]
        bit = (byte[:, None] >> (7 - j)) & 1
        return np.log2(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def slot_of(string: Column, slots: int) -> Column:
    """Number of the task that holds the contexts with the same last TOP + 1 bytes."""
    return F.pmod(F.xxhash64(F.shiftright(string, 8).bitwiseAND((1 << 8 * (TOP + 1)) - 1)), F.lit(slots)).cast("int")


def by_slot(rows: DataFrame, n: int):
    """``rows`` grouped by slot, with so many slots that none holds much more than SLOT_STRINGS of ``n``."""
    slots = max(6, -(-n // SLOT_STRINGS))
    return rows.withColumn("slot", slot_of(F.col("string"), slots)).groupBy("slot")


def sorted_strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.sort_by("string")
    return table["string"].to_numpy(), table["n"].to_numpy()


def top_of(counts: DataFrame, n: int) -> tuple[list[tuple], tuple | None]:
    """The top of the tree from (string, n): nodes of contexts of at most TOP bytes."""

    def sums(table: pa.Table) -> pa.Table:
        node, a, b, below = lower_levels(*sorted_strings(table))[1]
        return pa.table({"node": node, "a": a, "b": b, "below": below})

    found = by_slot(counts, n).applyInArrow(sums, "node long, a double, b double, below double").groupBy("node").agg(
        *[F.sum(c).alias(c) for c in ("a", "b", "below")]).toArrow()
    return top_tables(*(found[c].to_numpy() for c in ("node", "a", "b", "below")))


def frequent_logs(counts: DataFrame, n: int, top, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings in rising order, log2 probability) of the most frequent strings, at most ``bound`` of them.

    Their numbers are cut at one of eight steps for each doubling.
    """
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(
        F.count(F.lit(1)).alias("strings"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for step in steps:
        total += step.strings
        if total > bound:
            break
        least = step.least
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float64)

    def logs(table: pa.Table) -> pa.Table:
        values, numbers = sorted_strings(table)
        often = values[numbers >= least]
        return pa.table({"string": often, "log": Coder(top, lower_levels(values, numbers)[0]).logs_of(often)})

    found = by_slot(counts, n).applyInArrow(logs, "string long, log double").toArrow().sort_by("string")
    return found["string"].to_numpy(), found["log"].to_numpy()


def other_logs(asked: DataFrame, counts: DataFrame, n: int, top) -> DataFrame:
    """(_id, deeper): sum of the log2 probabilities of ``asked`` (_id, string, times), each in the task of its group."""
    shared = asked.sparkSession.sparkContext.broadcast(top)  # the top of the tree
    whole = n + asked.count()

    def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
        values, codes = np.unique(asked["string"].to_numpy(), return_inverse=True)
        each = Coder(shared.value, lower_levels(*sorted_strings(counts))[0]).logs_of(values)[codes] * asked["times"].to_numpy()
        ids, row = np.unique(asked["_id"].to_numpy(), return_inverse=True)
        return pa.table({"_id": ids, "log": np.bincount(row, weights=each, minlength=len(ids))})

    found = by_slot(asked, whole).cogroup(by_slot(counts, whole)).applyInArrow(run, "_id long, log double")
    return found.groupBy("_id").agg(F.sum("log").alias("deeper"))


# --- scores ------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
          sent_strings: int = SENT_STRINGS, word_share: int = WORD_SHARE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    Learns from all rows whose ``held_out`` is false. ``score`` is the log10 probability
    that the context tree gives to the tokens of the text, ``bits_per_byte`` its code
    length per byte (tokens joined by a space, one end mark). ``base_score`` is that of
    single words: log10((c + 0.1) / (N + 0.1 (V + 1))) summed over words and one end
    token, c being the token's count, N the number and V the kinds of training tokens;
    ``n_known`` counts tokens with c > 0. Words of at least 1 / ``word_share`` of all are
    summed where the text is, the others are joined with their counts; the ``sent_strings``
    most frequent strings of bytes are summed where the text is, the others in the tasks
    that hold their contexts, by the same tree. Null and empty texts are one end token; a null ``held_out`` is held out; repeated rows count and are
    scored one by one; without training rows every bit costs 1 and N is 0; empty tables
    give empty tables; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(text).alias("_text"), F.col(key).alias("_key"),
                       F.coalesce(held_out, F.lit(True)).alias("_held"))
    training = rows.where(~F.col("_held"))
    counts = reliable_checkpoint(string_counts(training.select("_text")), "strings")
    n_strings = counts.count()
    top = top_of(counts, n_strings)
    frequent, frequent_log = frequent_logs(counts, n_strings, top, sent_strings)
    words = reliable_checkpoint(word_counts(training, "_text", lower=True), "words")
    n_texts = training.count()
    of_words = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    total = (of_words.n or 0) + n_texts
    kinds = of_words.kinds + (1 if n_texts else 0)
    whole = total + 0.1 * (kinds + 1)
    often = F.col("n") * word_share >= total
    found = words.where(often).toArrow()
    model = spark.sparkContext.broadcast(
        (frequent, frequent_log, dict(zip(found["word"].to_pylist(), found["n"].to_pylist())), n_texts, float(whole)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, sent_log, counts, ends, whole = model.value
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            size = batch.num_rows
            logs, n_bytes = np.zeros(size), np.zeros(size, np.int64)
            deep: list[tuple[np.ndarray, ...]] = []
            for at, parts in pieces(batch.column(0)):
                values, sizes = strings(parts)
                codes, distinct = pd.factorize(values)
                distinct = distinct.view(np.int64)
                found = np.minimum(np.searchsorted(sent, distinct), max(len(sent) - 1, 0))
                left_open = sent[found] != distinct if len(sent) else np.ones(len(distinct), bool)
                each = np.where(left_open, 0, sent_log[found] if len(sent) else 0)[codes]
                there = left_open[codes]
                pair, n = np.unique(np.repeat(at, sizes)[there] * len(distinct) + codes[there], return_counts=True)
                deep.append((pair // max(len(distinct), 1), distinct[pair % max(len(distinct), 1)], n))
                np.add.at(logs, at, np.add.reduceat(np.r_[each, 0.0], np.cumsum(sizes) - sizes) * (sizes > 0))
                np.add.at(n_bytes, at, sizes)
            tokens, known = np.ones(size, np.int64), np.full(size, int(ends > 0), np.int64)
            base = np.full(size, np.log10((ends + 0.1) / whole))
            rare: list[pa.Table] = []
            for at, group in byte_groups(batch.column(0)):
                distinct, codes, place = coded_words(group, lower=True)
                c = np.fromiter((counts.get(w, 0) for w in distinct.to_pylist()), np.float64, len(distinct))
                of_row = at[place]
                tokens += np.bincount(of_row, minlength=size)
                frequent = (c > 0)[codes]
                known += np.bincount(of_row[frequent], minlength=size)
                base += np.bincount(of_row, weights=np.where(c > 0, np.log10((c + 0.1) / whole), 0)[codes], minlength=size)
                pair, n = np.unique(of_row[~frequent] * max(len(distinct), 1) + codes[~frequent], return_counts=True)
                row, code = np.divmod(pair, max(len(distinct), 1))
                rare.append(pa.table({"row": row, "word": distinct.take(pa.array(code)), "n": n.astype(np.int64)}))
            listed = pa.concat_tables(rare).sort_by("row").combine_chunks() if rare else None
            row = listed["row"].to_numpy() if listed else np.zeros(0, np.int64)
            offsets = np.searchsorted(row, np.arange(size + 1)).astype(np.int32)
            plain = lambda name: listed[name].combine_chunks()
            structs = pa.StructArray.from_arrays([plain("word"), plain("n")], ["word", "n"])
            deep_row, string, times = (np.concatenate(c).astype(np.int64) for c in zip((np.zeros(0, np.int64),) * 3, *deep))
            order = np.argsort(deep_row, kind="stable")
            deep_offsets = np.searchsorted(deep_row[order], np.arange(size + 1)).astype(np.int32)
            strings_left = pa.StructArray.from_arrays([pa.array(string[order]), pa.array(times[order])], ["string", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(serial + np.arange(size)), batch.column(1), batch.column(2), pa.array(tokens), pa.array(known),
                 pa.array(base), pa.array(logs), pa.array(n_bytes), pa.ListArray.from_arrays(pa.array(offsets), structs),
                 pa.ListArray.from_arrays(pa.array(deep_offsets), strings_left)],
                ["_id", "_key", "held_out", "n_tokens", "n_known", "base_score", "logs", "n_bytes", "rare", "deep"])
            serial += size

    kind = rows.schema["_key"].dataType.simpleString()
    scored = reliable_checkpoint(rows.mapInArrow(
        run, f"_id long, _key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, logs double, "
             "n_bytes long, rare array<struct<word: string, n: long>>, deep array<struct<string: long, n: long>>"), "scored")
    deep = scored.select("_id", F.inline("deep").alias("string", "times"))
    deeper = other_logs(deep, counts, n_strings, top)
    rare = scored.select("_id", F.inline("rare").alias("word", "times")).join(
        words.where(~often), "word", "left").groupBy("_id").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(float(whole)))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more_known"))
    nothing = F.lit(0)
    bits = F.col("logs") + F.coalesce("deeper", F.lit(0.0))
    return scored.drop("rare", "deep").join(rare, "_id", "left").join(deeper, "_id", "left").select(
        F.col("_key").alias(key), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", nothing)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", nothing)).alias("base_score"), (bits * F.lit(float(np.log10(2)))).alias("score"),
        (-bits / F.col("n_bytes")).alias("bits_per_byte"))
