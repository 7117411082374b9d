"""Token counts: an exact length histogram with suffix sums.

Documents are encoded once with a public tokenizer; each task hands on only
(length, documents) pairs, so the shuffle carries distinct lengths, not
documents.  Suffix sums over the histogram then answer, for every context
limit at once, how many documents reach it, how many tokens remain when
longer texts are truncated, and which quantile the limit is.

Suffix sums are taken inside slices of 256 lengths and joined with the
sums of later slices (one row per 256 tokens of the longest document), so
no task sees the whole histogram.

Defined cases: null or empty text has length 0; special-token strings in a
text are ordinary text; an empty table has an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, shipped, unpacked
from shelfwise.plans.materialize import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 256


class Encoder:
    """A byte-level BPE read once on the driver and built once per Python worker."""

    def __init__(self, ranks_file: str, pattern: str = PATTERN) -> None:
        with open(ranks_file, "rb") as f:
            self.ranks, self.pattern, self._built = f.read(), pattern, None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "_built": None}

    def built(self):  # noqa: ANN201
        """The encoding of the tiktoken package, needed only where texts are encoded."""
        import tiktoken

        if self._built is None:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, self.ranks.splitlines())}
            self._built = tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._built

    def lengths(self, texts: Iterable[str | None]) -> np.ndarray:
        encode = self.built().encode_ordinary
        return np.array([len(encode(t)) if t else 0 for t in texts], dtype=np.int64)


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """n_tokens, n_docs: documents by encoded length."""
    # a vocabulary file of fixed size, read on the driver: executors need no copy
    encoder = shipped(docs.sparkSession, Encoder(vocabulary, pattern))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpacked(encoder)
        for b in batches:
            n, times = np.unique(own.lengths(b.column(0).to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(times.astype(np.int64))], ["n_tokens", "n_docs"])

    counted = columns_of(docs, text="text").mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit:

    docs_ge, tokens_ge (documents this long or longer, and their tokens),
    truncated_total (tokens left when every text is cut to the limit),
    quantile (share of documents that fit).
    """
    # read twice below: written once (a row per distinct length), or every text would be encoded twice
    histogram = materialize(histogram, "length_histogram")
    h = histogram.withColumn("slice", F.floor(F.col("n_tokens") / SLICE)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    sums = h.groupBy("slice").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t"))
    later = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = sums.select(
        "slice", F.coalesce(F.sum("d").over(later), zero).alias("later_d"), F.coalesce(F.sum("t").over(later), zero).alias("later_t"),
        F.sum("d").over(whole).alias("all_d"), F.sum("t").over(whole).alias("all_t"),
    )
    inside = Window.partitionBy("slice").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        h.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn("tokens_in", F.sum("t").over(inside))
        .join(offsets, "slice")
        .withColumn("docs_ge", F.col("docs_in") + F.col("later_d"))
        .withColumn("tokens_ge", F.col("tokens_in") + F.col("later_t"))
    )
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("all_t") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_d")).alias("quantile"),
    )


def answer_limits(table: DataFrame, limits: list[int]) -> dict[int, int]:
    """Truncated total for any context limits, from the suffix-sum table.

    Between two lengths that occur, the first one at or above the limit has
    all the documents that reach it.
    """
    if not limits:
        return {}
    at = [F.min_by(F.struct("n_tokens", "docs_ge", "truncated_total"), F.when(F.col("n_tokens") >= n, F.col("n_tokens"))).alias(f"at_{i}") for i, n in enumerate(limits)]
    row = table.agg(*at, F.max_by("truncated_total", "n_tokens").alias("total")).first()
    out = {}
    for i, n in enumerate(limits):
        x = row[f"at_{i}"]
        out[n] = (row["total"] or 0) if x is None or x["n_tokens"] is None else x["truncated_total"] - (x["n_tokens"] - n) * x["docs_ge"]
    return out


def answer_quantiles(table: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest context limit that holds each share of the documents whole."""
    if not shares:
        return {}
    row = table.agg(*[F.min(F.when(F.col("quantile") >= F.lit(q), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    return {q: row[f"q{i}"] for i, q in enumerate(shares)}
