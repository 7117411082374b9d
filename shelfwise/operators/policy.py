"""Policy diagnosis: status, root cause and priority per pair.

The rules test the *unrounded* pair rates (a 19.996 % low-cover rate is
not "low" here, while the rounded assessment in E4 treats it as 20 %).
Order metrics come from the same pair rollup row, so the reference's
left join to a second aggregate is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise import config as L
from shelfwise.config import DEFAULT, Thresholds
from shelfwise.functions import lit, num, order_case, pct, round_half_up, select_list, sql

PRIORITY_ORDER = [L.PRIORITY_HIGH, L.PRIORITY_MEDIUM, L.PRIORITY_LOW]
POLICY_LABELS = ["policy_status", "root_cause_hint", "priority_band"]

# fixed values: the published column lists
POLICY_COLUMNS = [
    "store_id", "product_id", "category_clean", "region_clean",
    "total_units_sold", "total_units_ordered", "avg_order_size_on_order_days",
    "replenishment_to_sales_ratio", "avg_daily_units_sold", "avg_inventory_level",
    "avg_cover_days", "low_cover_pct", "high_cover_pct", "zero_inventory_pct",
    "order_day_pct", "wape", "forecast_bias",
    "total_at_risk_units_proxy", "total_excess_units_proxy",
    "abc_segment", "velocity_segment", "forecast_segment", "inventory_position_segment",
    *POLICY_LABELS,
]


def policy_labels(t: Thresholds = DEFAULT) -> list[str]:
    """policy_status, root_cause_hint, priority_band over unrounded pair rates."""
    under = (
        f"(avg_cover_days < {num(t.low_cover_days)} OR low_cover_rate >= {num(t.low_cover_rate)}"
        f" OR zero_inventory_rate >= {num(t.zero_inventory_rate)})"
    )
    over = f"(avg_cover_days > {num(t.high_cover_days)} OR high_cover_rate >= {num(t.high_cover_rate)})"
    forecast = f"(wape > {num(t.wape_poor)} OR abs(forecast_bias) > {num(t.bias_abs)})"
    ratio_off = (
        f"(replenishment_to_sales_ratio > {num(t.ratio_high)}"
        f" OR replenishment_to_sales_ratio < {num(t.ratio_low)})"
    )
    replen = (
        f"({ratio_off} OR order_day_rate > {num(t.order_day_rate_high)}"
        f" OR order_day_rate < {num(t.order_day_rate_low)})"
    )
    return [
        f"""CASE WHEN {under} AND {over} THEN {lit(L.STATUS_MIXED)}
       WHEN {under} THEN {lit(L.STATUS_UNDER)}
       WHEN {over} THEN {lit(L.STATUS_OVER)}
       ELSE {lit(L.STATUS_STABLE)} END AS policy_status""",
        f"""CASE WHEN {forecast} AND {replen} THEN {lit(L.CAUSE_BOTH)}
       WHEN {forecast} THEN {lit(L.CAUSE_FORECAST)}
       WHEN {replen} THEN {lit(L.CAUSE_REPLENISHMENT)}
       ELSE {lit(L.CAUSE_MONITOR)} END AS root_cause_hint""",
        f"""CASE WHEN ({under} OR {over}) AND ({forecast} OR {ratio_off}) THEN {lit(L.PRIORITY_HIGH)}
       WHEN {under} OR {over} THEN {lit(L.PRIORITY_MEDIUM)}
       ELSE {lit(L.PRIORITY_LOW)} END AS priority_band""",
    ]


SEGMENTS = ["abc_segment", "velocity_segment", "forecast_segment", "inventory_position_segment"]


def policy_diagnosis(pairs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rounded pair measures, segment labels and the three policy labels.

    On the pair rollup instead of the segments it gives all but the segment
    labels, which is what the distributions and summaries read.
    """
    r = round_half_up
    cols = [
        "store_id", "product_id", "category_clean", "region_clean",
        "total_units_sold", "total_units_ordered",
        f"{r('avg_order_size_on_order_days', 2)} AS avg_order_size_on_order_days",
        f"{r('replenishment_to_sales_ratio', 2)} AS replenishment_to_sales_ratio",
        f"{r('avg_daily_units_sold', 2)} AS avg_daily_units_sold",
        f"{r('avg_inventory_level', 2)} AS avg_inventory_level",
        f"{r('avg_cover_days', 2)} AS avg_cover_days",
        f"{pct('low_cover_rate')} AS low_cover_pct",
        f"{pct('high_cover_rate')} AS high_cover_pct",
        f"{pct('zero_inventory_rate')} AS zero_inventory_pct",
        f"{pct('order_day_rate')} AS order_day_pct",
        f"{r('wape', 4)} AS wape",
        f"{r('forecast_bias', 4)} AS forecast_bias",
        "total_at_risk_units_proxy", "total_excess_units_proxy",
        *(c for c in SEGMENTS if c in pairs.columns),
        *policy_labels(t),
    ]
    return sql(f"SELECT {select_list(cols)} FROM {{pairs}}", pairs=pairs)


_BY_SALES = "total_units_sold DESC NULLS FIRST, product_id, store_id"


def policy_row_count(pd: DataFrame) -> DataFrame:
    """D3."""
    return sql("SELECT count(*) AS policy_rows FROM {pd}", pd=pd)


def policy_top20(pd: DataFrame, n: int = 20) -> DataFrame:
    """D4."""
    return sql(f"SELECT * FROM {{pd}} ORDER BY {_BY_SALES} LIMIT {n}", pd=pd)


def _distribution(pd: DataFrame, label: str, order: str) -> DataFrame:
    return sql(
        f"""
SELECT {label}, count(*) AS sku_store_count, CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold
FROM {{pd}} GROUP BY {label} ORDER BY {order}
""",
        pd=pd,
    )


def policy_status_distribution(pd: DataFrame) -> DataFrame:
    """D5."""
    return _distribution(pd, "policy_status", "policy_status")


def root_cause_distribution(pd: DataFrame) -> DataFrame:
    """D6."""
    return _distribution(pd, "root_cause_hint", "root_cause_hint")


def priority_distribution(pd: DataFrame) -> DataFrame:
    """D7."""
    return _distribution(pd, "priority_band", order_case("priority_band", PRIORITY_ORDER))


def policy_null_labels(pd: DataFrame) -> DataFrame:
    """Pairs with a missing policy label (expected empty)."""
    return pd.where(" OR ".join(f"{n} IS NULL" for n in POLICY_LABELS))


def diagnosis_master(pd: DataFrame) -> DataFrame:
    """The diagnosis export, by priority then units sold."""
    return sql(
        f"SELECT {', '.join(POLICY_COLUMNS)} FROM {{pd}} "
        f"ORDER BY {order_case('priority_band', PRIORITY_ORDER)}, {_BY_SALES}",
        pd=pd,
    )


def policy_status_summary(pd: DataFrame) -> DataFrame:
    """D10 (averages of already rounded columns, as published)."""
    return sql(
        f"""
SELECT policy_status, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  {round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days,
  {round_half_up('avg(wape)', 4)} AS avg_wape,
  CAST(sum(total_at_risk_units_proxy) AS DECIMAL(38,6)) AS total_at_risk_units_proxy,
  CAST(sum(total_excess_units_proxy) AS DECIMAL(38,6)) AS total_excess_units_proxy
FROM {{pd}} GROUP BY policy_status ORDER BY policy_status
""",
        pd=pd,
    )


def root_cause_summary(pd: DataFrame) -> DataFrame:
    """D11."""
    return sql(
        f"""
SELECT root_cause_hint, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  {round_half_up('avg(wape)', 4)} AS avg_wape,
  {round_half_up('avg(replenishment_to_sales_ratio)', 2)} AS avg_replenishment_to_sales_ratio,
  CAST(sum(total_at_risk_units_proxy) AS DECIMAL(38,6)) AS total_at_risk_units_proxy,
  CAST(sum(total_excess_units_proxy) AS DECIMAL(38,6)) AS total_excess_units_proxy
FROM {{pd}} GROUP BY root_cause_hint ORDER BY root_cause_hint
""",
        pd=pd,
    )


def _two_way(pd: DataFrame, dim: str) -> DataFrame:
    return sql(
        f"""
SELECT {dim}, policy_status, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  CAST(sum(total_at_risk_units_proxy) AS DECIMAL(38,6)) AS total_at_risk_units_proxy,
  CAST(sum(total_excess_units_proxy) AS DECIMAL(38,6)) AS total_excess_units_proxy
FROM {{pd}} GROUP BY {dim}, policy_status ORDER BY {dim}, policy_status
""",
        pd=pd,
    )


def category_policy_summary(pd: DataFrame) -> DataFrame:
    """D12."""
    return _two_way(pd, "category_clean")


def region_policy_summary(pd: DataFrame) -> DataFrame:
    """D13."""
    return _two_way(pd, "region_clean")


HIGH_PRIORITY_COLUMNS = [
    "store_id", "product_id", "category_clean", "region_clean",
    "total_units_sold", "total_units_ordered", "replenishment_to_sales_ratio",
    "avg_cover_days", "low_cover_pct", "high_cover_pct", "zero_inventory_pct",
    "wape", "forecast_bias", "total_at_risk_units_proxy", "total_excess_units_proxy",
    "abc_segment", "velocity_segment", "forecast_segment", "inventory_position_segment",
    *POLICY_LABELS,
]


def high_priority_items(pd: DataFrame) -> DataFrame:
    """High-priority pairs, 22 columns, by units sold."""
    return sql(
        f"SELECT {', '.join(HIGH_PRIORITY_COLUMNS)} FROM {{pd}} "
        f"WHERE priority_band = {lit(L.PRIORITY_HIGH)} ORDER BY {_BY_SALES}",
        pd=pd,
    )
