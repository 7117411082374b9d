"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces no longer than the largest sequence and the
pieces are packed, longest first, into the open bin that they fit most
tightly.  A piece that fits no open bin opens a new one of the least-cost
permitted length; each group of pieces is packed once per smallest length
that may be opened, bins are finally cut down to the shortest permitted
length that holds their contents, and the cheapest outcome is taken.

Spark deals pieces by a seeded hash into groups of about 4,096 that are
packed independently: a group is a random sample of all lengths, so it
packs as well as the whole and needs bounded memory however large the
corpus or one key is.  Equal rows are first counted, then numbered as
copies, so a repeated id is spread over groups too.

Defined cases: a null or empty text is a piece of one token (its end mark);
a null id is packed like any id; ties in length go by id, copy and piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of
from shelfwise.plans.materialize import materialize

CAPACITIES = (2048, 8192, 32768)
GROUP_ROWS = 4096
RESULT = "doc_id long, copy int, piece int, start long, length int, pack_group int, bin int, bin_offset int, bin_fill int, capacity int"


def sequence_cost(capacity: float, per_sequence: float = 64.0, attention: float = 1 / 32768) -> float:
    """Training cost of one sequence: a fixed part, one unit a token and a quadratic part for attention."""
    return per_sequence + capacity + attention * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], smallest: int, cost: Callable[[float], float]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, capacity of each bin) for lengths in packing order.

    New bins hold at least ``smallest``; among the permitted lengths that fit,
    the one of least cost a token is opened.
    """
    opened = [min((c for c in capacities if c >= max(n, smallest)), key=lambda c: (cost(c) / c, c)) for n in lengths]
    room: list[int] = []  # distinct free spaces, ascending
    bins_with: dict[int, list[int]] = {}
    fills: list[int] = []
    where, offsets = [], []
    sizes: list[int] = []
    for n, new in zip(lengths, opened, strict=True):
        i = bisect_left(room, n)
        if i < len(room):
            space = room[i]
            b = bins_with[space].pop()
            if not bins_with[space]:
                del bins_with[space], room[i]
        else:
            b, space = len(fills), new
            fills.append(0)
            sizes.append(new)
        where.append(b)
        offsets.append(fills[b])
        fills[b] += n
        if space > n:
            if space - n not in bins_with:
                insort(room, space - n)
                bins_with[space - n] = []
            bins_with[space - n].append(b)
    final = [capacities[bisect_left(capacities, f)] for f in fills]
    return where, offsets, final


def pack_group(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[float], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings over all smallest lengths, after downsizing."""
    options = [best_fit(lengths, capacities, c, cost) for c in capacities]
    return min(options, key=lambda o: sum(map(cost, o[2])))


def pieces_of(docs: DataFrame, length: Column, most: int) -> DataFrame:
    """doc_id, copy, piece, start, length: every token of every row in exactly one piece."""
    sized = docs.select("doc_id", length.cast("long").alias("len"))
    counted = sized.groupBy("doc_id", "len").agg(F.count("*").cast("int").alias("n"))
    copies = counted.select("doc_id", "len", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    last = F.floor((F.col("len") - 1) / most).cast("int")
    return copies.select("doc_id", "copy", "len", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "copy", "piece", (F.col("piece").cast("long") * most).alias("start"),
        F.least(F.lit(most).cast("long"), F.col("len") - F.col("piece").cast("long") * most).cast("int").alias("length"), "len",
    )


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, seed: int = 31, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Where each piece of each document goes: span of the document, bin, offset in it, the bin's final capacity.

    ``length`` (over doc_id and text) is a row's tokens, by default its
    UTF-8 bytes plus an end mark; copies of equal (id, length) rows are
    numbered from 0.
    """
    caps = tuple(sorted(capacities))
    rows = columns_of(docs, doc_id="doc_id", text="text")
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if length is None else length
    pieces = materialize(pieces_of(rows, length, caps[-1]), "pack_pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    # the hash also takes the length: rows that share an id but not a length differ in it
    key = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "len", "copy", "piece")
    dealt = pieces.withColumn("pack_group", F.pmod(key, F.lit(groups)).cast("int")).drop("len")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "copy", "piece", "start"], ascending=[False, True, True, True, True], ignore_index=True)
        where, offsets, final = pack_group(group["length"].tolist(), caps)
        fills = np.bincount(where, weights=group["length"]).astype(np.int32)
        return group.assign(bin=np.array(where, np.int32), bin_offset=np.array(offsets, np.int32), bin_fill=fills[where], capacity=np.array(final, np.int32)[where])[
            ["doc_id", "copy", "piece", "start", "length", "pack_group", "bin", "bin_offset", "bin_fill", "capacity"]
        ].astype({"doc_id": "Int64"})

    return dealt.groupBy("pack_group").applyInPandas(pack, RESULT)
