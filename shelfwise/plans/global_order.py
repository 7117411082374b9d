"""Whole-table ordering (running sums, row numbers, tiles) without one task.

``SUM() OVER (ORDER BY ...)`` and ``NTILE(n) OVER (ORDER BY ...)``
with no ``PARTITION BY`` plan as ``Exchange SinglePartition``: every row
goes through one task.  Here the same results are computed the way a
distributed sort works:

1. ``repartitionByRange`` samples the full composite sort key (value
   plus tie-breaks), so buckets stay balanced even when one value is
   shared by a third of all rows (several orderings share one range
   shuffle, see :func:`global_orders`);
2. the bucket id is frozen by writing the bucketed rows once
   (:func:`materialize`), so a re-executed task can never move a row;
3. a window partitioned by bucket gives the local row number and
   running sum;
4. the per-bucket totals (one row per million rows) give exclusive
   offsets that are joined back; the planner broadcasts them by size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import sql
from shelfwise.plans.materialize import materialize

DEFAULT_ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class Key:
    """One sort key: column, direction and NULL placement (SQL semantics)."""

    col: str
    desc: bool = False
    nulls_first: bool | None = None  # None = Spark default (first for ASC, last for DESC)

    @property
    def _nulls_first(self) -> bool:
        return (not self.desc) if self.nulls_first is None else self.nulls_first

    def sql(self) -> str:
        return f"{self.col} {'DESC' if self.desc else 'ASC'} NULLS {'FIRST' if self._nulls_first else 'LAST'}"

    def column(self) -> Column:
        c = F.col(self.col)
        if self.desc:
            return c.desc_nulls_first() if self._nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self._nulls_first else c.asc_nulls_last()


def bucket_count(n_rows: int, rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> int:
    return max(1, math.ceil(n_rows / max(1, rows_per_bucket)))


def ntile(n_tiles: int, rn: str, n_rows: str) -> str:
    """SQL ``NTILE(n_tiles)`` from a global row number and the row count.

    The first ``N mod n`` tiles hold ``N div n + 1`` rows, the rest
    ``N div n`` rows.
    """
    q = f"({n_rows} div {n_tiles})"
    m = f"({n_rows} % {n_tiles})"
    big = f"({m} * ({q} + 1))"
    return (
        f"CAST(CASE WHEN {rn} <= {big} THEN ({rn} - 1) div ({q} + 1) + 1 "
        f"ELSE {m} + ({rn} - 1 - {big}) div NULLIF({q}, 0) + 1 END AS INT)"
    )


def global_orders(
    df: DataFrame,
    orders: dict[str, list[Key]],
    *,
    keys: list[str],
    buckets: int,
    sums: dict[str, str] | None = None,
    name: str = "orders",
    registry: list[str] | None = None,
) -> DataFrame:
    """Several whole-table orderings of ``df`` with one range shuffle and one write.

    Every row is emitted once per ordering (``_kind``), each copy carrying
    only its own ordering's sort columns; one ``repartitionByRange`` over
    ``(_kind, <all sort columns>)`` then places all orderings in disjoint
    key ranges, so the bucketed rows are written once for all of them.

    Returns ``keys`` plus, for every ordering ``o``: ``rn_o`` (global
    1-based row number) and ``n_o`` (row count); for ``o`` in ``sums``
    also ``running_o`` (sum of ``sums[o]`` over rows up to this one) and
    ``total_o``.  Each ordering must be total (end with unique keys).
    """
    sums = sums or {}
    names = list(orders)
    if not names:
        raise ValueError("no orderings")
    sort_cols: list[tuple[int, int, Key]] = [
        (i, m, k) for i, o in enumerate(names) for m, k in enumerate(orders[o])
    ]
    key_list = ", ".join(f"`{k}`" for k in keys)

    def branch(i: int, o: str) -> str:
        cols = [f"{i} AS _kind", key_list]
        for j, m, k in sort_cols:
            cols.append(f"{k.col if j == i else f'NULL'} AS _k{j}_{m}")
        cols.append(f"CAST({sums[o]} AS BIGINT) AS _v" if o in sums else "CAST(NULL AS BIGINT) AS _v")
        return f"SELECT {', '.join(cols)} FROM {{df}}"

    stacked = sql("\nUNION ALL\n".join(branch(i, o) for i, o in enumerate(names)), df=df)
    order_keys = [Key("_kind")] + [
        Key(f"_k{j}_{m}", desc=k.desc, nulls_first=k._nulls_first) for j, m, k in sort_cols
    ]
    placed = stacked.repartitionByRange(buckets * len(names), *[k.column() for k in order_keys])
    ranged = materialize(placed.withColumn("_go_bucket", F.spark_partition_id()), f"{name}-buckets", registry)
    order = ", ".join(k.sql() for k in order_keys)
    w = f"PARTITION BY _go_bucket, _kind ORDER BY {order}"
    upto = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "(PARTITION BY _kind ORDER BY _go_bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    pivot = []
    for i, o in enumerate(names):
        pivot.append(f"max(CASE WHEN _kind = {i} THEN rn END) AS rn_{o}")
        pivot.append(f"max(CASE WHEN _kind = {i} THEN n END) AS n_{o}")
        if o in sums:
            pivot.append(f"max(CASE WHEN _kind = {i} THEN running END) AS running_{o}")
            pivot.append(f"max(CASE WHEN _kind = {i} THEN total END) AS total_{o}")
    return sql(
        f"""
WITH local AS (
  SELECT _go_bucket, _kind, {key_list},
    row_number() OVER ({w}) AS lrn,
    sum(_v) OVER {upto} AS lsum,
    count(_v) OVER {upto} AS lnn
  FROM {{ranged}}
),
-- one row per (bucket, ordering), a millionth of the rows
per_bucket AS (
  SELECT _go_bucket, _kind, count(*) AS bn, sum(_v) AS bs, count(_v) AS bnn
  FROM {{ranged}} GROUP BY _go_bucket, _kind
),
offsets AS (
  SELECT _go_bucket, _kind,
    coalesce(sum(bn) OVER {before}, 0) AS off_n,
    coalesce(sum(bs) OVER {before}, 0) AS off_s,
    coalesce(sum(bnn) OVER {before}, 0) AS off_nn,
    CAST(sum(bn) OVER (PARTITION BY _kind) AS BIGINT) AS n,
    sum(bs) OVER (PARTITION BY _kind) AS total
  FROM per_bucket
),
ranked AS (
  SELECT l._kind, {', '.join(f'l.`{k}`' for k in keys)},
    CAST(o.off_n + l.lrn AS BIGINT) AS rn,
    o.n,
    CASE WHEN o.off_nn + l.lnn > 0 THEN o.off_s + coalesce(l.lsum, 0) END AS running,
    o.total
  FROM local l JOIN offsets o ON l._go_bucket = o._go_bucket AND l._kind = o._kind
)
SELECT {key_list}, {', '.join(pivot)}
FROM ranked
GROUP BY {key_list}
""",
        ranged=ranged,
    )
