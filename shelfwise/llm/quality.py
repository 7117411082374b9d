"""Quality rules: a threshold table compiled into one Spark projection.

Each text is measured once with SQL array functions (no user functions, no
shuffle): words, characters in words, symbols, lines, repeated lines, words
in repeated 3-word windows, stop words.  The rule table - name, ratio,
bounds - then becomes plain column expressions over those counts.

Repeated windows: every 3-word window gets a 64-bit hash; sorting
(hash, position) pairs puts equal windows side by side, and the positions
that have an equal neighbour are merged into covered words.  This is
n log n in the text's length, whatever repeats.  Texts without any repeated
window (distinct hashes = windows) skip the sort.

Defined cases: null text counts as empty (no words: base rules fail, not
kept); white space is ASCII only; repeated rows are judged alike; ids are
never used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, filtered, pinned

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as on be at by this from or an are "
    "der die das und in zu den mit von für ist nicht ein eine im auf dem sich des "
    "le la les de des et un une est que qui dans pour sur pas au du en "
    "el los las y del al que se no una con por para su un es"
)


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``numerator / denominator`` lies in [least, most]; an empty denominator passes."""

    name: str
    numerator: str
    denominator: str = ""
    least: float | None = None
    most: float | None = None

    def column(self, count: Callable[[str], Column] = F.col) -> Column:
        """The rule over the counts that ``count`` gives by name."""
        value = count(self.numerator)
        if self.denominator:
            value = F.when(count(self.denominator) > 0, value / count(self.denominator))
        bounds = [value >= F.lit(self.least)] * (self.least is not None) + [value <= F.lit(self.most)] * (self.most is not None)
        held = F.lit(True)
        for b in bounds:
            held = held & b
        return F.coalesce(held, F.lit(True))


# The production threshold table.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("repetition", "n_repeat_words", "n_words", most=0.5),
    Rule("word_length_min", "word_chars", "n_words", least=2),
    Rule("word_length_max", "word_chars", "n_words", most=20),
    Rule("symbols", "n_symbols", "n_words", most=0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: it is bound as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _span(first: int, last: Column) -> Column:
    """The array first..last; empty if last is smaller (sequence() would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more."""

    def merged(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.aggregate(positions, start, step, lambda a: a["total"])

    def repeated(pairs: Column, n: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        at = F.filter(_span(0, n - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return merged(F.sort_array(F.transform(at, lambda i: F.get(pairs, i)["i"])))

    def counted(windows: Column) -> Column:
        n = F.size(windows)
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("long")).otherwise(_let(pairs, lambda p: repeated(p, n)))

    windows = F.transform(_span(0, F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, counted)


def _features(text: Column, stop_words: list[str]) -> Column:
    # every spelling by case is listed: a set lookup a word is cheaper than lower() a word
    stops = sorted({f(w) for w in stop_words for f in (str.lower, str.capitalize, str.upper)})

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    n_symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long")
    return F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), n_symbols.alias("n_symbols"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]


def measured(df: DataFrame, text: str, keep: list[str], stop_words: str = STOP_WORDS) -> DataFrame:
    """The columns ``keep`` and the counts that rules refer to."""
    f = df.select(*keep, _let(F.coalesce(F.col(text), F.lit("")), lambda t: _features(t, stop_words.split())).alias("f"))
    return f.select(*keep, "f.w.n_words", "f.w.word_chars", "f.n_symbols", "f.l.n_lines", "f.l.n_dup_lines", "f.w.n_repeat_words", "f.w.n_stop_words")


def verdict(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(names of the failed rules, whether none failed)."""
    failed = F.filter(F.array(*[F.when(~r.column(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return failed, F.size(failed) == 0


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, failed_rules, kept."""
    rows = measured(columns_of(docs, doc_id="doc_id", text="text"), "text", ["doc_id"])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed, passed = verdict(rules)
    return rows.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & passed)


def _passes(text: Column, rules: tuple[Rule, ...], stop_words: str = STOP_WORDS) -> Column:
    """Whether a text passes every rule, as one expression that measures it once.

    A filter over :func:`measured` rows would be pushed below the projection
    and measure the text again at each reference.
    """
    part = {"n_lines": "l", "n_dup_lines": "l", "n_symbols": None}

    def held(f: Column) -> Column:
        count = lambda name: f[name] if part.get(name, "w") is None else f[part.get(name, "w")][name]
        out = F.lit(True)
        for r in rules:
            out = out & r.column(count)
        return out

    return _let(F.coalesce(text, F.lit("")), lambda t: _let(_features(t, stop_words.split()), held))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with their own columns."""
    inner, (text,) = pinned(docs, "text")
    return filtered(docs, _passes(F.col(text), rules), inner)
