"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

Words are the letter runs of whole texts, counted in one pass.  The trie of
all words is a table of edges, (node, next letters), whose nodes are named by
their prefix; an edge also names the letter after it, so that states without a
future are not made.  A state (word, position, node, edits) says that the word's
letters before ``position`` lead to ``node`` with so many edits.  Level by level
the states meet the edges of their node: a state without an edit goes on along
its own letter, or takes another child (one letter replaced), or skips a letter
(one letter left out); a state with its edit behind it only follows its own
letters.  States that end at a word with one edit are neighbours.

Two things keep the frontier small.  The word and its reverse are both in the
trie, under different roots, and a word is only edited in its second half from
either end: the way there needs no join, as the word itself leads along it, and
no state spreads at the wide levels near the root.  And a pair is found from one
side: by the longer word, or by the one with the smaller letter at the place.

Words longer than ``LONGEST`` code points (strings of junk, as a rule) would take
a level for each letter.  They take the rest of their path in one step: node and
remaining letters together name the end, by a rolling hash that can be put
together from both parts.  Their pairs are confirmed by edit distance.

Every level is one join by node between tables written to the checkpoint folder;
nothing is collected but the number of levels.  A node that many words share
is split by the planner's skew join.

Defined cases: null text has no words; a null doc_id counts as the empty string
in the hash; rows that repeat are counted each; without words the result is
empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, mix64
from shelfwise.plans.materialize import materialize, remove_written

LEAST_LETTERS = 7
LEAST_COUNT = 2
DROP_EVERY = 31  # a run whose hash this divides loses a letter
FORM_RATIO = 10
LONGEST = 40
HELD_WORDS = 100_000  # distinct words that a task counts before it sends them on

RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
LOWER = {i: i + 32 for i in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words_of(text: str, doc_id: str) -> Counter:
    """The text's words with their counts; equal runs of one text lose the same letter."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    runs: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        runs[run.translate(LOWER)] += n
    for run, n in runs.items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % DROP_EVERY == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur often enough, over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    held.update(words_of(text, "" if doc_id is None else doc_id))
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = columns_of(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT).withColumn("length", F.length("word"))


# ---- the trie ---------------------------------------------------------------
def oriented(words: DataFrame) -> DataFrame:
    """Each word forwards and backwards, under two roots: o, n, length and the first position that is edited.

    Of a word's positions the later half is edited forwards, the other one
    backwards.  ``o`` begins with the root's mark, so the node at depth d is its
    first d + 1 letters.
    """
    half = F.floor(F.col("length") / 2).cast("int")
    ways = F.array(
        F.struct(F.concat(F.lit(">"), "word").alias("o"), half.alias("start")),
        F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("o"), (F.col("length") - half).alias("start")),
    )
    return words.select("length", F.explode(ways).alias("w")).select("w.o", "length", "w.start")


def _letters(at: str, n: int) -> str:
    """SQL for ``n`` letters of a word (fewer at its end) at a position from 0; the mark before it counts."""
    return f"substring(o, {at} + 2, {n})"


def edges_at(ways: DataFrame, depth: int) -> DataFrame:
    """edge_node, children: what leads on from each node of one level: a letter and the one after it, or alone where a word ends."""
    there = ways.where(f"start <= {depth} AND {depth} < length")
    return there.groupBy(F.expr(f"substring(o, 1, {depth + 1})").alias("edge_node")).agg(F.collect_set(F.expr(_letters(str(depth), 2))).alias("children"))


def step(ways: DataFrame, states: DataFrame | None, depth: int) -> DataFrame:
    """The one-edit states that the states at nodes of this depth lead to."""
    unedited = ways.where(f"start <= {depth} AND {depth} < length").selectExpr("o", f"{depth} AS pos", f"substring(o, 1, {depth + 1}) AS node", "0 AS edits")
    here = unedited if states is None else unedited.unionByName(states.where("pos < length(o) - 1").withColumn("edits", F.lit(1)))
    own, after = _letters("pos", 2), _letters("pos + 1", 2)
    to = lambda pos, letters: f"named_struct('pos', {pos}, 'node', concat(node, left({letters}, 1)))"
    follow = f"CASE WHEN array_contains(children, {own}) THEN array({to('pos + 1', own)}) END"
    replaced = f"transform(filter(children, c -> left(c, 1) > left({own}, 1) AND substring(c, 2) = substring({own}, 2)), c -> {to('pos + 1', 'c')})"
    left_out = f"CASE WHEN {after} <> '' AND array_contains(children, {after}) THEN array({to('pos + 2', after)}) ELSE array() END"
    ways_on = f"CASE WHEN edits = 1 THEN {follow} ELSE concat({replaced}, {left_out}) END"
    met = here.join(edges_at(ways, depth), F.col("node") == F.col("edge_node"))
    return met.selectExpr("o", f"explode({ways_on}) AS t").selectExpr("o", "t.pos", "t.node")


def trie_pairs(words: DataFrame, written: list[str]) -> DataFrame:
    """word, other: neighbours among words of at most LONGEST code points, each pair from one side."""
    short = words.where(f"length <= {LONGEST}")
    first, last = short.agg(F.min(F.floor(F.col("length") / 2)), F.max("length")).first()
    ways = materialize(oriented(short), "oriented_words", written)
    # the last letter left out ends at the node before it
    ends = ways.selectExpr("o", "substring(o, 1, length) AS node")
    states: DataFrame | None = None
    for depth in range(first or 0, last or 0):
        states = materialize(step(ways, states, depth), "trie_states", written)
        ends = ends.unionByName(states.where("pos = length(o) - 1").select("o", "node"))
    read = lambda c: F.expr(f"CASE WHEN {c} LIKE '<%' THEN reverse(substring({c}, 2)) ELSE substring({c}, 2) END")
    return ends.select(read("o").alias("word"), read("node").alias("other"))


def long_pairs(words: DataFrame) -> DataFrame:
    """word, other: neighbours among words of LONGEST code points or more, by the names of their ends; to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word in b.column(0).to_pylist():
                x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
                power = np.cumprod(np.append(np.uint64(1), np.full(len(x) - 1, _BASE)))
                before = np.append(np.uint64(0), np.cumsum(x * power))
                # the node before a position, with all letters after it: one place nearer, or in their places
                without = before[:-1] + (before[-1] - before[1:]) * _BASE_BACK
                but_one = mix64(before[-1] - x * power + mix64(np.arange(1, len(x) + 1, dtype=np.uint64)))
                key = np.concatenate([before[-1:], without, but_one])
                kind = np.repeat(np.array([0, 1, 2], np.int32), [1, len(x), len(x)])
                length = np.repeat(np.array([len(x), len(x) - 1, len(x)], np.int32), [1, len(x), len(x)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(before[-1:], len(key)).view(np.int64)), pa.array(key.view(np.int64)), pa.array(kind), pa.array(length)], ["id", "key", "kind", "length"])

    long = words.where(f"length >= {LONGEST}").select("word")
    ends = long.mapInArrow(run, "id long, key long, kind int, length int")
    whole = ends.where("kind = 0").selectExpr("key", "length")
    shorter = ends.where("kind = 1").select("id", "key", "length").join(whole, ["key", "length"]).selectExpr("id", "key AS other_id")
    # at most a letter of the alphabet each: a group stays small
    alike = ends.where("kind = 2").groupBy("key", "length").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1")
    replaced = alike.selectExpr("explode(ids) AS id", "ids").selectExpr("id", "explode(filter(ids, x -> x > id)) AS other_id")
    named = long.mapInArrow(_ids, "word string, id long")
    pairs = shorter.unionByName(replaced).distinct()
    other = named.selectExpr("word AS other", "id AS other_id")
    found = pairs.join(named, "id").join(other, "other_id").where("word <> other AND levenshtein(word, other, 1) = 1")
    # words of LONGEST code points meet in the trie
    return found.where(f"greatest(length(word), length(other)) > {LONGEST}").select("word", "other")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = []
        for word in b.column(0).to_pylist():
            x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            ids.append(int((x * np.cumprod(np.append(np.uint64(1), np.full(len(x) - 1, _BASE)))).sum(dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64())], ["word", "id"])


# ---- forms ------------------------------------------------------------------
def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: each word's number of neighbours and its form."""
    known = words.selectExpr("word AS other", "n AS other_n")
    # an end that is no word finds no partner here
    one_way = pairs.distinct().join(known, "other").join(words.select("word", "n"), "word")
    both = one_way.select("word", "other", "other_n").unionAll(one_way.selectExpr("other AS word", "word AS other", "n AS other_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    enough = F.expr(f"-best.less >= {FORM_RATIO} * n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(forms: DataFrame, written: list[str]) -> DataFrame:
    """root_word, root for each word with a form: the end of its chain of forms, by doubling.

    A form occurs ten times as often as its word, so a chain is as long as a
    count has digits at most.
    """
    spark = forms.sparkSession
    jump = materialize(forms.where("form IS NOT NULL").selectExpr("word AS root_word", "form AS root"), "form_roots", written)
    while True:
        on = jump.selectExpr("root_word AS at", "root AS next")
        further = jump.join(on, F.col("root") == F.col("at"), "left")
        if further.where("next IS NOT NULL").isEmpty():
            return jump
        done = written.pop()
        jump = materialize(further.select("root_word", F.coalesce("next", "root").alias("root")), "form_roots", written)
        remove_written(spark, [done])


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its most frequent variant and the end of the chain."""
    spark = docs.sparkSession
    own: list[str] = []
    kept: list[str] = []
    words = materialize(count_words(docs), "words", own)
    pairs = trie_pairs(words, own)
    if not words.where(f"length >= {LONGEST}").isEmpty():
        pairs = pairs.unionByName(long_pairs(words))
    forms = materialize(with_forms(words, pairs), "word_forms", kept)
    remove_written(spark, own)
    ends = roots(forms, kept)
    out = forms.join(ends, F.col("word") == F.col("root_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
