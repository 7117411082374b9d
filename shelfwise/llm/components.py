"""Connected components by alternating star contraction.

Each round links every node's larger neighbours to the smallest node it
knows (large star), then every node's smaller neighbours likewise (small
star), until only stars are left: edges then run from each node straight to
the smallest node of its component.  Rounds grow with the logarithm of a
component's size; every round is two aggregations and two joins over edges,
written to the checkpoint folder, so neither lineage nor a hub's neighbours
pile up anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.plans.materialize import materialize, remove_written


ROWS_PER_FILE = 250_000


def in_few_files(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` of at most about ``rows`` rows in as many partitions as they need, 8 at least.

    Intermediate tables here are far smaller than the input that the
    session's partition count is meant for.
    """
    return df.coalesce(max(8, -(-rows // per_file)))


def dealt_to_few_files(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Like :func:`in_few_files`, behind a shuffle: the steps before keep their own number of tasks.

    For a small table made from a large one.  Else every task writes a small
    file of its own, and where the checkpoint folder is on a local file
    system, an executor starts three child processes (chmod) for each.
    """
    return in_few_files(df.hint("rebalance"), rows, per_file)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and none of those ends has one itself."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): with the smallest of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("mu")).drop("mu")


def connected(edges: DataFrame, written: list[str]) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b), but for the smallest of each component, that smallest node.

    ``written`` collects the path of the returned table.
    """
    spark = edges.sparkSession
    own: list[str] = []

    def step(df: DataFrame, rows: int) -> DataFrame:
        return materialize(in_few_files(df.where("a <> b").distinct(), rows), "edges", own)

    rows = edges.count()
    edges = step(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows)
    while not _is_stars(edges):
        both = edges.selectExpr("a AS u", "b AS v").unionAll(edges.selectExpr("b AS u", "a AS v"))
        down = step(_to_smallest(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), 2 * rows)
        tops = _to_smallest(down.selectExpr("a AS u", "b AS v"))
        edges = step(tops.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(tops.select(F.col("u").alias("a"), F.col("m").alias("b"))), 2 * rows)
        done = own[:-1]
        own[:] = own[-1:]
        remove_written(spark, done)
    written.extend(own)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
