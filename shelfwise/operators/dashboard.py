"""Dashboard marts: the data behind the executive overview page.

Shares of a grand total divide by a scalar subquery (one value shipped
to every task), never ``SUM() OVER ()``, which would move every row into
one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise import config as L
from shelfwise.functions import count_if, lit, order_case, round_half_up, safe_div, sql, sum_if
from shelfwise.operators.kpi import is_merged
from shelfwise.operators.policy import PRIORITY_ORDER


def dash_headline(bi: DataFrame) -> DataFrame:
    """G1: headline KPI tiles."""
    excess_sales = sum_if(f"impact_theme = {lit(L.THEME_EXCESS)}", "total_units_sold")
    return sql(
        f"""
SELECT CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  count(*) AS sku_store_combinations,
  CAST(sum(primary_impact_units_proxy) AS DECIMAL(38,6)) AS primary_impact_units,
  {count_if(f"impact_theme = {lit(L.THEME_BURDEN)}")} AS operational_burden_items,
  {count_if(f"impact_priority = {lit(L.PRIORITY_HIGH)}")} AS high_priority_items,
  {round_half_up(f"100.0D * {excess_sales} / CAST(NULLIF(sum(total_units_sold), 0) AS DOUBLE)", 2)} AS excess_sales_share_pct
FROM {{bi}}
""",
        bi=bi,
    )


def dash_monthly_units(kb: DataFrame) -> DataFrame:
    """Monthly units sold, flagging a month the data does not cover to its end."""
    month, sold, day = ("month", "sold", "last_date") if is_merged(kb) else ("trunc(date, 'MM')", "units_sold", "date")
    return sql(
        f"""
SELECT month, total_units_sold,
  CASE WHEN last_date < last_day(month) THEN 1 ELSE 0 END AS incomplete_month_flag
FROM (
  SELECT {month} AS month,
         CAST(sum({sold}) AS BIGINT) AS total_units_sold,
         max({day}) AS last_date
  FROM {{kb}} GROUP BY {month}
)
ORDER BY month
""",
        kb=kb,
    )


def dash_monthly_wape(kb: DataFrame) -> DataFrame:
    """Monthly forecast accuracy (WAPE) and bias."""
    merged = is_merged(kb)
    month = "month" if merged else "trunc(date, 'MM')"
    absolute, error, sold = ("abs_err", "err", "sold") if merged else ("abs_forecast_error", "forecast_error", "units_sold")
    return sql(
        f"""
SELECT {month} AS month,
  {round_half_up(safe_div(f'sum({absolute})', f'sum({sold})'), 4)} AS wape,
  {round_half_up(safe_div(f'sum({error})', f'sum({sold})'), 4)} AS forecast_bias
FROM {{kb}} GROUP BY {month} ORDER BY month
""",
        kb=kb,
    )


def dash_priority_by_region(bi: DataFrame) -> DataFrame:
    """Region x impact priority counts (long form)."""
    return sql(
        f"""
SELECT region_clean, impact_priority, count(*) AS sku_store_count
FROM {{bi}} GROUP BY region_clean, impact_priority
ORDER BY region_clean, {order_case('impact_priority', PRIORITY_ORDER)}
""",
        bi=bi,
    )


def _share(bi: DataFrame, dim: str, measure: str, total_name: str, pct_name: str, kind: str = "DECIMAL(38,6)") -> DataFrame:
    return sql(
        f"""
WITH grouped AS (
  SELECT {dim}, CAST(sum({measure}) AS {kind}) AS {total_name} FROM {{bi}} GROUP BY {dim}
)
-- the grand total is a scalar subquery: one value, shipped to every task
SELECT {dim}, {total_name},
  {round_half_up(f"100.0D * {total_name} / CAST(NULLIF((SELECT sum({measure}) FROM {{bi}}), 0) AS DOUBLE)", 2)}
    AS {pct_name}
FROM grouped
ORDER BY {total_name} DESC NULLS FIRST, {dim}
""",
        bi=bi,
    )


def dash_impact_by_region(bi: DataFrame) -> DataFrame:
    """Primary impact units per region and share of the total."""
    return _share(bi, "region_clean", "primary_impact_units_proxy", "primary_impact_units", "impact_share_pct")


def dash_impact_by_category(bi: DataFrame) -> DataFrame:
    """Primary impact units per category and share of the total."""
    return _share(bi, "category_clean", "primary_impact_units_proxy", "primary_impact_units", "impact_share_pct")


def dash_sales_by_category(bi: DataFrame) -> DataFrame:
    """Units sold per category and share of the total."""
    return _share(bi, "category_clean", "total_units_sold", "total_units_sold", "sales_share_pct", "BIGINT")


def dash_trigger_counts(ra: DataFrame) -> DataFrame:
    """Pairs per reorder-trigger assessment."""
    return sql(
        """
SELECT reorder_behavior_assessment, count(*) AS sku_store_count
FROM {ra} GROUP BY reorder_behavior_assessment ORDER BY reorder_behavior_assessment
""",
        ra=ra,
    )
