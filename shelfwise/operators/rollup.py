"""The SKU-store pair rollup: one aggregation serving C1, D1 and E3.

The three pair-level views of the analysis (segment summary, order
metrics, replenishment base) aggregate the same KPI rows by the same keys,
and the canonical labels are counts over the same rows.  One scan of the
fact combines it per (store, product, raw category, raw region) into
mergeable sums (partial per task, so a hot pair costs one partial row per
task); the written table gives both the label maps and the pair rows, and
each view is a narrow projection of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.functions import pct, round_half_up, safe_div, select_list, sql
from shelfwise.operators import cadence
from shelfwise.operators.quality import label_maps

PAIR_KEYS = ["store_id", "product_id", "category_clean", "region_clean"]
JOIN_KEYS = ["store_id", "product_id"]

SUMMARY_COLUMNS = [
    *PAIR_KEYS,
    "row_count", "total_units_sold", "avg_daily_units_sold", "avg_inventory_level",
    "avg_cover_days", "low_cover_rate", "high_cover_rate", "zero_inventory_rate",
    "order_day_rate", "wape", "forecast_bias",
    "total_at_risk_units_proxy", "total_excess_units_proxy",
]
# unrounded averages: exact in the last bits only up to summation order
UNROUNDED_DOUBLES = [
    "avg_daily_units_sold", "avg_inventory_level", "avg_cover_days", "low_cover_rate",
    "high_cover_rate", "zero_inventory_rate", "order_day_rate", "wape", "forecast_bias",
]


_SQUARE = "sum(CAST({0} AS DECIMAL(20,6)) * CAST({0} AS DECIMAL(20,6)))"
# mergeable sums of the KPI rows: all exact but the one of cover days
_SUMS = {
    "n": "count(*)",
    "sold": "sum(units_sold)",
    "sold_n": "count(units_sold)",
    "sold_sq": _SQUARE.format("units_sold"),
    "inv": "sum(inventory_level)",
    "inv_n": "count(inventory_level)",
    "cover": "sum(cover_days)",
    "cover_n": "count(cover_days)",
    "low": "sum(low_cover_flag)",
    "high": "sum(high_cover_flag)",
    "zero": "sum(zero_inventory_flag)",
    "order_rows": "sum(CASE WHEN units_ordered > 0 THEN 1 ELSE 0 END)",
    "order_units": "sum(CASE WHEN units_ordered > 0 THEN units_ordered END)",
    "ordered": "sum(units_ordered)",
    "abs_err": "sum(abs_forecast_error)",
    "err": "sum(forecast_error)",
    "at_risk": "sum(at_risk_units_proxy)",
    "excess": "sum(excess_units_proxy)",
    "fc": "sum(demand_forecast_clean)",
    "fc_n": "count(demand_forecast_clean)",
    "fc_sq": _SQUARE.format("demand_forecast_clean"),
}


def pair_sums(kb: DataFrame) -> DataFrame:
    """Mergeable sums of the (unlabelled) KPI base per pair and raw labels: the only pass over the fact."""
    keys = "store_id, product_id, category, region"
    sums = [f"{e} AS {n}" for n, e in _SUMS.items()]
    return sql(f"SELECT {keys}, {select_list(sums)} FROM {{kb}} GROUP BY {keys}", kb=kb)


def pair_blocks(kb: DataFrame, monthly: bool = False) -> DataFrame:
    """:func:`pair_sums` split by blocks of 64 days, with the order days and squared order sizes that cadence needs.

    One state serves both: merged per pair it gives the rollup, merged per
    (pair, block) the cadence (:func:`order_blocks_of`), so the assessment and
    the impact view pass over the fact once.  ``monthly`` splits the blocks by
    month, too: then the KPI grains are merged from them (:func:`kpi_cube_of`).
    """
    keys = "store_id, product_id, category, region"
    month = ", trunc(date, 'MM')" if monthly else ""
    shown = f"{month} AS month, max(date) AS last_date" if monthly else ""
    sums = [f"{e} AS {n}" for n, e in _SUMS.items()]
    # an order row without a date counts, but has no day in a mask
    order_state = [
        "sum(CASE WHEN units_ordered > 0 THEN CAST(units_ordered AS DECIMAL(38,0)) * units_ordered END) AS order_sq",
        f"bit_or(CASE WHEN units_ordered > 0 THEN {cadence.day_bit('day')} END) AS order_days",
    ]
    return sql(
        f"""
SELECT {keys}{shown}, {cadence.block_of('day')} AS block, {select_list([*sums, *order_state])}
FROM (SELECT *, {cadence.DAY} AS day FROM {{kb}})
GROUP BY {keys}{month}, {cadence.block_of('day')}
""",
        kb=kb,
    )


def kpi_cube_of(blocks: DataFrame) -> DataFrame:
    """The partial sums of :func:`kpi.kpi_cube`, from the written monthly :func:`pair_blocks`."""
    names = {"inv": "inv_sum", "cover": "cover_sum", "low": "low_n", "high": "high_n", "zero": "zero_n"}
    same = ["n", "sold", "inv_n", "ordered", "cover_n", "abs_err", "err", "at_risk", "excess"]
    keys = ["month", "store_id", "region", "product_id", "category", "last_date"]
    return blocks.selectExpr(*keys, *same, *[f"{a} AS {b}" for a, b in names.items()])


def order_blocks_of(blocks: DataFrame) -> DataFrame:
    """The rows of :func:`cadence.order_blocks`, from the written :func:`pair_blocks`."""
    return sql(
        """
SELECT store_id, product_id, block, sum(order_rows) AS n, CAST(sum(order_units) AS DECIMAL(38,0)) AS s,
       sum(order_sq) AS ss, bit_or(order_days) AS days
FROM {blocks} WHERE order_rows > 0
GROUP BY store_id, product_id, block
""",
        blocks=blocks,
    )


def _sd(n: str, s: str, sq: str) -> str:
    """Sample standard deviation from exact count, sum and sum of squares."""
    spread = f"(CAST({n} * {sq} - CAST({s} AS DECIMAL(30,6)) * {s} AS DOUBLE) / CAST(NULLIF({n} * ({n} - 1), 0) AS DOUBLE))"
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest({spread}, 0.0D)) END"


def pair_rollup(sums: DataFrame) -> DataFrame:
    """Unrounded per-pair aggregates with canonical labels, from the written :func:`pair_sums` or :func:`pair_blocks`.

    The canonical category and region are functions of product and store, so
    the lookups join one row per pair.  Cover days are the one average over
    doubles; it is cut to 10 digits, so no threshold depends on the order of
    summation.
    """
    merged = [f"sum({n}) AS {n}" for n in _SUMS]
    measures = [
        "n AS row_count",
        "CAST(sold AS BIGINT) AS total_units_sold",
        f"{safe_div('sold', 'sold_n')} AS avg_daily_units_sold",
        f"{safe_div('inv', 'inv_n')} AS avg_inventory_level",
        f"{round_half_up(safe_div('cover', 'cover_n'), 10)} AS avg_cover_days",
        f"{safe_div('low', 'n')} AS low_cover_rate",
        f"{safe_div('high', 'n')} AS high_cover_rate",
        f"{safe_div('zero', 'n')} AS zero_inventory_rate",
        f"{safe_div('order_rows', 'n')} AS order_day_rate",
        "CAST(at_risk AS DECIMAL(38,6)) AS total_at_risk_units_proxy",
        "CAST(excess AS DECIMAL(38,6)) AS total_excess_units_proxy",
        "CAST(ordered AS BIGINT) AS total_units_ordered",
        f"{safe_div('order_units', 'order_rows')} AS avg_order_size_on_order_days",
        f"{_sd('sold_n', 'sold', 'sold_sq')} AS demand_stddev",
        f"{safe_div('fc', 'fc_n')} AS avg_daily_forecast",
        f"{_sd('fc_n', 'fc', 'fc_sq')} AS forecast_stddev",
        f"{safe_div('abs_err', 'sold')} AS wape",
        f"{safe_div('err', 'sold')} AS forecast_bias",
        f"{safe_div('ordered', 'sold')} AS replenishment_to_sales_ratio",
    ]
    return sql(
        f"""
WITH agg AS (
  SELECT store_id, product_id, {select_list(merged)} FROM {{sums}} GROUP BY store_id, product_id
)
SELECT a.store_id, a.product_id, pm.label AS category_clean, sm.label AS region_clean,
  {select_list(measures)}
FROM agg a
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'product') pm ON a.product_id = pm.id
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'store') sm ON a.store_id = sm.id
""",
        sums=sums,
        maps=label_maps(sums),
    )


def exact(col: str, digits: int | None) -> str:
    """Expose an unrounded average cut to ``digits`` (for cross-engine checks)."""
    return f"{round_half_up(col, digits)} AS {col}" if digits else col


def sku_store_summary(rollup: DataFrame, exact_digits: int | None = None) -> DataFrame:
    """The unrounded pair summary.

    ``exact_digits`` rounds the unrounded averages for comparisons across
    engines (their last bits depend on summation order).
    """
    return rollup.selectExpr(
        *[exact(n, exact_digits) if n in UNROUNDED_DOUBLES else n for n in SUMMARY_COLUMNS]
    )


def sku_store_count(rollup: DataFrame) -> DataFrame:
    """C2."""
    return sql("SELECT count(*) AS sku_store_rows FROM {r}", r=rollup)


def sku_store_top20(rollup: DataFrame, exact_digits: int | None = 10, n: int = 20) -> DataFrame:
    """Top pairs by units sold (tie-break product, store)."""
    return sql(
        f"SELECT * FROM {{s}} ORDER BY total_units_sold DESC NULLS FIRST, product_id, store_id LIMIT {n}",
        s=sku_store_summary(rollup, exact_digits),
    )


def order_metrics(rollup: DataFrame) -> DataFrame:
    """Per-pair order totals, order size on order days, order/sales ratio."""
    return rollup.selectExpr(
        *JOIN_KEYS,
        "total_units_ordered",
        exact("avg_order_size_on_order_days", 10),
        exact("replenishment_to_sales_ratio", 10),
    )


def replenishment_columns() -> list[str]:
    """E3 columns (rounded) as expressions over the unrounded rollup."""
    r = round_half_up
    return [
        *PAIR_KEYS,
        "row_count",
        "total_units_sold",
        "total_units_ordered",
        f"{r('avg_daily_units_sold', 2)} AS avg_daily_demand",
        f"{r('demand_stddev', 2)} AS demand_stddev",
        f"{r(safe_div('demand_stddev', 'avg_daily_units_sold'), 4)} AS demand_cv",
        f"{r('avg_daily_forecast', 2)} AS avg_daily_forecast",
        f"{r('forecast_stddev', 2)} AS forecast_stddev",
        f"{r('avg_inventory_level', 2)} AS avg_inventory_level",
        f"{r('avg_cover_days', 2)} AS avg_cover_days",
        f"{pct('low_cover_rate')} AS low_cover_pct",
        f"{pct('high_cover_rate')} AS high_cover_pct",
        f"{pct('zero_inventory_rate')} AS zero_inventory_pct",
        f"{pct('order_day_rate')} AS order_day_pct",
        f"{r('wape', 4)} AS wape",
        f"{r('forecast_bias', 4)} AS forecast_bias",
        "total_at_risk_units_proxy",
        "total_excess_units_proxy",
    ]


REPLENISHMENT_COLUMNS = [
    *PAIR_KEYS, "row_count", "total_units_sold", "total_units_ordered",
    "avg_daily_demand", "demand_stddev", "demand_cv", "avg_daily_forecast", "forecast_stddev",
    "avg_inventory_level", "avg_cover_days", "low_cover_pct", "high_cover_pct",
    "zero_inventory_pct", "order_day_pct", "wape", "forecast_bias",
    "total_at_risk_units_proxy", "total_excess_units_proxy",
]


def replenishment_base(rollup: DataFrame) -> DataFrame:
    """The rounded replenishment-behaviour base."""
    return sql(f"SELECT {select_list(replenishment_columns())} FROM {{r}}", r=rollup)
