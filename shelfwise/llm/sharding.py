"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r
among n gets the fraction (r - 1/2) / n.  Sorting all rows by fraction
interleaves the sources in proportion everywhere, so cutting the order into
equal runs gives shards that all match the mixture, with row counts at most
one apart (law ``rows``).

Neither ordering meets in one task: ranks are taken inside (source, leading
digits of the seeded hash) and the global position inside equal slices of
the fraction; prefix sums of their counts, one row per slice, are added.
A source that holds most rows is spread over 4,096 slices.  The hash is of
id, digest and size, and equal rows are counted before they are ranked and
take consecutive places, so neither null nor repeated ids crowd a slice.

Defined cases: null text has no bytes (size 1, crc32 0); a null source is a
source of its own; ties in the hash are broken by id, digest, size and source,
and equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import columns_of, row_key, seeded_hex
from shelfwise.plans.materialize import materialize

HEX_DIGITS = 3
SLICES = 16**HEX_DIGITS
BLOCK = 100_000
TIES = ["doc_id", "text_crc32", "size"]


def _running_offset(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``base``: the sum of ``n`` over earlier slices."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def source_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (source, digest, tie columns, copies) with ``lo``, the copies before them in their source's order, and ``of``, all of it."""
    keyed = rows.withColumn("slice", F.substring("digest", 1, HEX_DIGITS))
    counts = keyed.groupBy("source", "slice").agg(F.sum("copies").alias("n"))
    bases = _running_offset(counts, ["source"], "slice")
    bases = bases.withColumn("of", F.sum("n").over(Window.partitionBy("source")))
    bases = bases.select(F.col("source").alias("b_source"), F.col("slice").alias("b_slice"), "base", "of")
    inside = Window.partitionBy("source", "slice").orderBy("digest", *TIES).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("upto", F.sum("copies").over(inside))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice"))
    return ranked.join(bases, same).withColumn("lo", F.col("upto") - F.col("copies") + F.col("base"))


def one_by_one(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row ``copies`` times with ``copy`` from 0; a row of many copies is spread over tasks in blocks."""
    few = rows.where(F.col("copies") <= block).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    blocks = rows.where(F.col("copies") > block).withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {block})")))
    blocks = blocks.repartition("digest", "block")
    many = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {block}L, least(copies, (block + 1) * {block}L) - 1)"))).drop("block")
    return few.unionByName(many)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 23) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = columns_of(docs, doc_id="doc_id", text="text", source="source").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    # equal rows are counted, so a hot one is a single row until its places are known
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    key = [F.col("text_crc32").cast("string"), F.col("size").cast("string")]
    ranked = source_ranks(rows.withColumn("digest", seeded_hex(seed, row_key(), *key)))
    ranked = materialize(ranked.select("doc_id", "source", "size", "text_crc32", "digest", "copies", "lo", "of"), "shard_ranks")
    total = ranked.agg(F.sum("copies")).first()[0] or 0
    fraction = (F.col("lo") + F.col("copy") + 1 - F.lit(0.5)) / F.col("of")
    spread = one_by_one(ranked).withColumn("fraction", fraction).withColumn("part", F.floor(F.col("fraction") * SLICES))
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    bases = _running_offset(counts.withColumn("all", F.lit(0)), ["all"], "part").select("part", "base")
    inside = Window.partitionBy("part").orderBy("fraction", "digest", *TIES, "source")
    placed = spread.withColumn("r", F.row_number().over(inside)).join(bases, "part")
    place = F.col("r") + F.col("base") - 1
    shard = F.expr(f"(place * {n_shards}L) div {max(total, 1)}L")
    # the first place of a shard: the smallest p with p * n_shards >= shard * total
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.withColumn("place", place.cast("long")).withColumn("shard", shard).withColumn("slot", F.col("place") - first)
        .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
