"""Shared small inputs: nulls, empties, long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns named like the operators' own, also in another case
CLASHING = ", kept string, rejected string, shard string, copy string, TEXT string, n string, in_0 string, rate string, component_id string"
LONG = " ".join(f"w{i % 997}x" for i in range(60_000))

AWKWARD = [
    (1, "The cat of the house sat on the mat and it was as happy as can be.", "en", "a", None),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, " \t\n\r ", "en", "a", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "The cat of the house sat on the mat and it was as happy as can be.", "en", "a", None),
    (6, "The cat of the house sat on the mat and it was as happy as can be.", "en", "a", None),
    (None, "a row without an id and with some words", "en", "b", None),
    (None, None, None, None, None),
    (-7, "123 456 !!! ###", "de", "c", 15),
    (8, "word", "de", "c", 4),
    (2**62, "\U0001f600 \U0001f600 astral ünïcödé ẞ", "de", None, 20),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def clashing(spark):
    extra = tuple("x" for _ in range(CLASHING.count(" string")))
    return spark.createDataFrame([r + extra for r in AWKWARD], DOCS + CLASHING)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    key = lambda r: [(x is not None, str(type(x)), x) for x in r]
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=key)
