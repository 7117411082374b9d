"""Mixing sources to target weights by Poisson replication.

Every source gets the mean repetition rate that brings its expected volume
to its target share.  A document's uniform number is a seeded hash of its
id; inverting the Poisson distribution of the source's rate at that number
gives the document's count, with no state shared between rows, so a lost
task repeats the same draws.  Replicas are dealt out by a seeded hash and
sorted by it inside partitions: a uniform global order from one shuffle.

Rates live in one row per source.  The table is written to the checkpoint
folder before the join, so the planner knows its bytes: it is broadcast
below the session's threshold, and beyond it joined with skew splitting.

Defined cases: a null source is a source of its own; null text counts as
empty; equal rows get equal counts (their draws share the id's hash);
without an id the text's digest takes its place; a source with no volume
keeps rate 1; ``targets`` leaves sources it does not name at rate 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import pinned, row_key, seeded_hex
from shelfwise.plans.materialize import materialize

UNIT = float(2**52)


def poisson_table(rate: float) -> tuple[int, list[float]]:
    """(k0, cdf at k0, k0+1, ...) up to where the rest is below 2**-53."""
    if not rate > 0:
        return 0, [1.0]
    spread = 12 * rate**0.5 + 30
    lo, hi = max(0, int(rate - spread)), int(rate + spread)
    # log k! over the window: exact sums up to lo once, then cumulative
    logs = np.log(np.arange(1, hi + 1, dtype=float))
    log_fact = np.concatenate([[0.0], np.cumsum(logs)])[lo:]
    k = np.arange(lo, hi + 1)
    return lo, np.cumsum(np.exp(k * np.log(rate) - rate - log_fact)).tolist()


# a type object, not DDL text: the module must import without a running session
POISSON_TABLE = T.StructType([T.StructField("k0", T.LongType()), T.StructField("cdf", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(POISSON_TABLE)
def _poisson(rate: pd.Series) -> pd.DataFrame:
    rows = [poisson_table(float(r)) for r in rate]
    return pd.DataFrame({"k0": [r[0] for r in rows], "cdf": [r[1] for r in rows]})


def repetition_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None) -> DataFrame:
    """One row per source: source, n_docs, volume (text bytes), rate, k0, cdf.

    Weights come from ``targets`` (share per source) or, without it, from
    volume ** alpha.  ``budget`` is the mixture's expected volume, by
    default that of the weighted sources.
    """
    volume = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stats = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(volume).alias("volume"))
    if targets is None:
        weight = F.sqrt("volume") if alpha == 0.5 else F.pow(F.col("volume"), F.lit(alpha))
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double")
    stats = materialize(stats.withColumn("weight", F.when(F.col("volume") > 0, weight)), "mix_sources")
    sums = stats.where("weight IS NOT NULL").agg(F.sum("weight"), F.sum("volume")).first()
    total, size = sums[0], budget if budget is not None else sums[1]
    rate = F.lit(1.0) if not total else F.when(F.col("weight").isNull(), F.lit(1.0)).otherwise(F.col("weight") / F.lit(float(total)) * F.lit(float(size)) / F.col("volume"))
    return stats.withColumn("rate", rate).withColumn("p", _poisson("rate")).select("source", "n_docs", "volume", "rate", "p.k0", "p.cdf")


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None, seed: int = 17) -> DataFrame:
    """Replicated documents in shuffled order: the input's columns, then ``copy`` (from 0), ``rate`` and ``shuffle_key``."""
    inner, (doc_id, text, source) = pinned(docs, "doc_id", "text", "source")
    rates = repetition_rates(inner.select(F.col(text).alias("text"), F.col(source).alias("source")), targets, alpha, budget)
    rates = materialize(rates.select(F.col("source").alias("mix_source"), "rate", "k0", "cdf"), "mix_rates")
    key = row_key(doc_id, text)
    uniform = F.conv(F.substring(seeded_hex(seed, key), 1, 13), 16, 10).cast("double") / F.lit(UNIT)
    counted = (
        inner.join(rates, F.col(source).eqNullSafe(F.col("mix_source")))
        # the lambda binds the uniform number, so it is computed once a row
        .withColumn("above", F.element_at(F.transform(F.array(uniform), lambda u: F.size(F.filter("cdf", lambda c: c <= u))), 1))
        .withColumn("n", (F.col("k0") + F.col("above")).cast("int"))
        .where("n > 0")
    )
    replicas = counted.select(*inner.columns, "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    keyed = replicas.withColumn("shuffle_key", seeded_hex(seed + 1, key, F.col("copy").cast("string")))
    shuffled = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.select(*inner.columns, "copy", "rate", "shuffle_key").toDF(*docs.columns, "copy", "rate", "shuffle_key")
