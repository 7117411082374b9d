"""Chat formatting: keep maximal logged conversations, then render them.

A chat service that logs a whole conversation after every turn leaves
snapshots: conversations that are a prefix of a longer one.  Every turn gets
a hash of its position, role and text; a running XOR of them over the
conversation's order is the hash of each turn prefix (two seeds, 128 bits).
A conversation is dropped when its full hash and length occur among the
distinct strict prefixes (an anti-join of two unique-keyed tables, so a first
turn or a whole conversation shared by a third of all rows is one key);
identical conversations keep the smallest ``conv_id``.  Only survivors' turns
are gathered and rendered.  DataFrame operations only.

Defined cases: rows without ``conv_id`` belong to no conversation and are
left out; turns are ordered by turn, role, text digest (nulls first) and
repeated rows are repeated turns; a null role or text renders as empty but
is a different turn from an empty one; turn numbers only give the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"
PREFIX = ["pos", "h1", "h2"]


def _digest(seed: int) -> Column:
    # a null is hashed as a flag: Spark's hash skips null values
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), h1, h2 of the prefix that it ends, is_last."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "d1", "d2")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.select("conv_id", "turn", "role", _digest(1).alias("d1"), _digest(2).alias("d2"))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("is_last", F.lead("pos").over(order).isNull())
        .withColumn("h1", F.bit_xor(F.xxhash64(F.lit(11), "pos", "d1", "d2")).over(upto))
        .withColumn("h2", F.bit_xor(F.xxhash64(F.lit(12), "pos", "d1", "d2")).over(upto))
        .select("conv_id", *PREFIX, "is_last")
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of each conversation that prefixes no longer one."""
    prefixes = turn_prefixes(turns)
    whole = prefixes.where("is_last").groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    strict = prefixes.where("NOT is_last").select(*PREFIX).distinct()
    return whole.join(strict, PREFIX, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def _rendered(template: str) -> Column:
    """``template`` with the turn's role and text; control marks inside them are broken up."""
    safe = {n: F.replace(F.coalesce(F.col(n), F.lit("")), F.lit("<|"), F.lit("< |")) for n in ("role", "text")}
    head, rest = template.split("{role}")
    mid, tail = rest.split("{text}")
    return F.concat(F.lit(head), safe["role"], F.lit(mid), safe["text"], F.lit(tail))


def format_chats(conversations: DataFrame, template: str = TURN) -> DataFrame:
    """Maximal conversations as training text: conv_id, n_turns, n_copies, rendered."""
    turns = columns_of(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    kept = maximal_conversations(turns)
    line = F.struct("turn", "role", _digest(1).alias("d1"), _digest(2).alias("d2"), _rendered(template).alias("line"))
    return (
        turns.select("conv_id", line.alias("line"))
        .join(kept, "conv_id")
        .groupBy("conv_id")
        .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("line")).alias("lines"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
    )
