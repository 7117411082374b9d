"""Order events and replenishment cadence.

The published formulation is LAG of the date over every order row of a
pair, so a pair with millions of rows would sit in one task.  Here order
rows are first combined per (pair, block of 64 days): the set of order
days is a bit mask (``bit_or``), orders and sizes are sums.  That is one
shuffle of the fact with map-side combine; everything after it handles at
most one row per 64 calendar days and pair.  The pair rollup can carry the
same state (:func:`shelfwise.operators.rollup.pair_blocks`); cadence then needs
no pass over the fact of its own.

The order before an order row comes from the masks, too: the highest bit below
its day, or else the last day of the pair's block before.

Gaps survive exactly.  The gaps of a pair add up to last day minus first
day, and repeated orders on a day add only zeros, so just the sum of
squared gaps needs consecutive order days: inside a block they are
neighbouring bits of the mask, across blocks the first bit here and the
last bit before.  Order-size and gap moments stay exact integers until
the final division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.functions import round_half_up, sql

CADENCE_COLUMNS = [
    "order_event_count", "avg_order_size_on_order_days", "order_size_stddev",
    "avg_days_between_orders", "stddev_days_between_orders",
]

_DEC = "DECIMAL(38,0)"

BLOCK_DAYS = 64


DAY = "datediff(CAST(date AS DATE), DATE'1970-01-01')"


def block_of(day: str) -> str:
    return f"floor({day} / {BLOCK_DAYS})"


def day_bit(day: str) -> str:
    """The day's bit in its block's mask."""
    return f"shiftleft(1L, CAST(pmod({day}, {BLOCK_DAYS}) AS INT))"


def _last_bit(mask: str) -> str:
    """Number of the highest bit of a mask that is not 0 (the sign bit is 63)."""
    return f"(length(bin({mask})) - 1)"


def order_rows(kb: DataFrame) -> DataFrame:
    """The order rows with their block and day in it: what E1 reads twice, so it is written in between."""
    return sql(
        f"""
SELECT store_id, product_id, order_date, units_ordered, {block_of('day')} AS block, CAST(pmod(day, {BLOCK_DAYS}) AS INT) AS place
FROM (SELECT store_id, product_id, CAST(date AS DATE) AS order_date, units_ordered, {DAY} AS day FROM {{kb}} WHERE units_ordered > 0)
""",
        kb=kb,
    )


def order_events(orders: DataFrame) -> DataFrame:
    """Order rows with the date of the order before them in the same pair, from the written :func:`order_rows`.

    The first copy of a key follows the previous order day, every further
    copy follows an order of the same day.  Rows move once, to their block;
    the window there holds the copies of one key, and the blocks' window holds
    a row per 64 days of a pair.
    """
    return sql(
        f"""
WITH blocks AS (
  SELECT store_id, product_id, block, bit_or(shiftleft(1L, place)) AS days FROM {{orders}} GROUP BY store_id, product_id, block
), placed AS (
  SELECT *, lag(block * {BLOCK_DAYS} + {_last_bit('days')}) OVER (PARTITION BY store_id, product_id ORDER BY block) AS last_before FROM blocks
), met AS (
  SELECT o.*, b.days & ~shiftleft(-1L, o.place) AS earlier, b.last_before
  FROM {{orders}} o
  JOIN placed b ON o.store_id <=> b.store_id AND o.product_id <=> b.product_id AND o.block <=> b.block
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY store_id, product_id, block, order_date ORDER BY units_ordered) AS copy FROM met
)
SELECT store_id, product_id, order_date, units_ordered,
  CASE WHEN copy > 1 OR order_date IS NULL THEN order_date
       ELSE date_add(DATE'1970-01-01', CAST(CASE WHEN earlier <> 0 THEN block * {BLOCK_DAYS} + {_last_bit('earlier')} ELSE last_before END AS INT)) END AS prev_order_date
FROM numbered
""",
        orders=orders,
    )


def order_blocks(kb: DataFrame) -> DataFrame:
    """Per (pair, block): orders ``n``, sum ``s`` and sum of squares ``ss`` of their sizes, and the mask of order days."""
    return sql(
        f"""
SELECT store_id, product_id, {block_of('day')} AS block, count(*) AS n,
       CAST(sum(units_ordered) AS {_DEC}) AS s,
       sum(CAST(units_ordered AS {_DEC}) * units_ordered) AS ss,
       bit_or({day_bit('day')}) AS days
FROM (SELECT *, {DAY} AS day FROM {{kb}} WHERE units_ordered > 0)
GROUP BY store_id, product_id, {block_of('day')}
""",
        kb=kb,
    )


def _mean_sd(n: str, s: str, ss: str) -> tuple[str, str]:
    """Mean and sample standard deviation from exact count, sum, sum of squares."""
    mean = f"(CAST({s} AS DOUBLE) / CAST(NULLIF({n}, 0) AS DOUBLE))"
    var = (
        f"(CAST(CAST({n} AS {_DEC}) * {ss} - {s} * {s} AS DOUBLE)"
        f" / CAST(NULLIF({n} * ({n} - 1), 0) AS DOUBLE))"
    )
    sd = f"CASE WHEN {n} > 1 THEN sqrt(greatest({var}, 0.0D)) END"
    return mean, sd


def order_cadence_raw(blocks: DataFrame) -> DataFrame:
    """Unrounded cadence per pair with at least one order, from :func:`order_blocks` rows."""
    size_mean, size_sd = _mean_sd("n", "s", "ss")
    # every order but the first has a predecessor: n - 1 gaps
    gap_mean, gap_sd = _mean_sd("(n - 1)", "gs", "gss")
    return sql(
        f"""
WITH placed AS (
  -- order days of a block as day numbers, ascending
  SELECT *, transform(filter(sequence(0, {BLOCK_DAYS - 1}), i -> getbit(days, i) = 1), i -> block * {BLOCK_DAYS} + i) AS at
  FROM {{blocks}}
), gaps AS (
  SELECT *,
    aggregate(sequence(1, size(at)), 0L,
              (acc, i) -> acc + CASE WHEN i < size(at) THEN (get(at, i) - get(at, i - 1)) * (get(at, i) - get(at, i - 1)) ELSE 0L END) AS inside,
    get(at, 0) - lag(get(at, size(at) - 1)) OVER (PARTITION BY store_id, product_id ORDER BY block) AS before
  FROM placed
), moments AS (
  SELECT store_id, product_id, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(ss) AS ss,
         CAST(max(get(at, size(at) - 1)) - min(get(at, 0)) AS {_DEC}) AS gs,
         CAST(sum(inside + coalesce(before * before, 0)) AS {_DEC}) AS gss
  FROM gaps
  GROUP BY store_id, product_id
)
SELECT store_id, product_id,
       n AS order_event_count,
       {size_mean} AS avg_order_size_on_order_days,
       {size_sd} AS order_size_stddev,
       {gap_mean} AS avg_days_between_orders,
       {gap_sd} AS stddev_days_between_orders
FROM moments
""",
        blocks=blocks,
    )


def order_cadence(blocks: DataFrame) -> DataFrame:
    """Rounded order cadence per pair with at least one order, from :func:`order_blocks` rows."""
    rounded = [f"{round_half_up(n, 2)} AS {n}" for n in CADENCE_COLUMNS[1:]]
    return order_cadence_raw(blocks).selectExpr("store_id", "product_id", "order_event_count", *rounded)
