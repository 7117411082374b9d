"""Business impact classification.

The published view joins the policy diagnosis to the assessment; both
are projections of the same pair rollup row here, so one left join to
the cadence table is all that is needed: policy labels are computed on
the unrounded rates, assessment labels on the rounded ones, in two
narrow projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise import config as L
from shelfwise.config import DEFAULT, Thresholds
from shelfwise.functions import count_if, lit, order_case, round_half_up, select_list, sql, sum_if
from shelfwise.operators.assessment import ASSESSMENT_LABELS, assessment_labels, cadence_join
from shelfwise.operators.policy import POLICY_LABELS, PRIORITY_ORDER, policy_labels
from shelfwise.operators.rollup import replenishment_columns

# fixed values: the published column lists
IMPACT_COLUMNS = [
    "store_id", "product_id", "category_clean", "region_clean",
    "total_units_sold", "total_units_ordered", "avg_inventory_level", "avg_cover_days",
    "low_cover_pct", "high_cover_pct", "zero_inventory_pct", "order_day_pct",
    "wape", "forecast_bias", "total_at_risk_units_proxy", "total_excess_units_proxy",
    *POLICY_LABELS,
    *ASSESSMENT_LABELS,
    "impact_theme", "impact_priority", "primary_impact_units_proxy", "primary_impact_vs_sales_ratio",
]


def business_impact(pairs: DataFrame, cadence: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """one row per pair with policy, assessment and impact labels.

    ``pairs`` is the pair rollup (or anything carrying its columns, such
    as the segments); no segment label is needed.
    """
    # step 1: policy labels need the unrounded rates of the pair rows
    pol = f"SELECT {select_list([*replenishment_columns(), *policy_labels(t)])} FROM {{pairs}}"
    excess = (
        f"(reorder_behavior_assessment = {lit(L.TRIGGER_EARLY)} OR policy_status = {lit(L.STATUS_OVER)})"
    )
    service = (
        f"(reorder_behavior_assessment = {lit(L.TRIGGER_LATE)} OR policy_status = {lit(L.STATUS_UNDER)})"
    )
    continuous = f"(lead_time_behavior_proxy = {lit(L.CADENCE_CONTINUOUS)})"
    return sql(
        f"""
WITH ra AS (
  -- step 2: assessment labels need the rounded rates and the cadence
  SELECT *, {select_list(assessment_labels(t))}
  FROM ({cadence_join(pol)})
), themed AS (
  SELECT *,
    CASE WHEN {excess} THEN {lit(L.THEME_EXCESS)}
         WHEN {service} THEN {lit(L.THEME_SERVICE)}
         WHEN {continuous} THEN {lit(L.THEME_BURDEN)}
         ELSE {lit(L.THEME_MONITOR)} END AS impact_theme,
    CASE WHEN {excess} AND priority_band = {lit(L.PRIORITY_HIGH)} THEN {lit(L.PRIORITY_HIGH)}
         WHEN {continuous} THEN {lit(L.PRIORITY_MEDIUM)}
         ELSE {lit(L.PRIORITY_LOW)} END AS impact_priority,
    CAST(CASE WHEN {excess} THEN total_excess_units_proxy
              WHEN {service} THEN total_at_risk_units_proxy
              ELSE 0 END AS DECIMAL(38,6)) AS primary_impact_units_proxy
  FROM ra
)
SELECT {', '.join(IMPACT_COLUMNS[:-1])},
  CASE WHEN total_units_sold > 0
       THEN CAST(primary_impact_units_proxy AS DOUBLE) / CAST(NULLIF(total_units_sold, 0) AS DOUBLE)
  END AS primary_impact_vs_sales_ratio
FROM themed
""",
        pairs=pairs,
        cad=cadence,
    )


_BY_SALES = "total_units_sold DESC NULLS FIRST, product_id, store_id"
_BY_URGENCY = (
    f"{order_case('impact_priority', PRIORITY_ORDER)}, primary_impact_units_proxy DESC NULLS FIRST, {_BY_SALES}"
)


def impact_row_count(bi: DataFrame) -> DataFrame:
    """F2."""
    return sql("SELECT count(*) AS impact_rows FROM {bi}", bi=bi)


def impact_top20(bi: DataFrame, n: int = 20) -> DataFrame:
    """F3."""
    return sql(f"SELECT * FROM {{bi}} ORDER BY {_BY_SALES} LIMIT {n}", bi=bi)


def _impact_dist(bi: DataFrame, keys: str, order: str) -> DataFrame:
    return sql(
        f"""
SELECT {keys}, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  CAST(sum(primary_impact_units_proxy) AS DECIMAL(38,6)) AS total_primary_impact_units_proxy
FROM {{bi}} GROUP BY {keys} ORDER BY {order}
""",
        bi=bi,
    )


def impact_theme_distribution(bi: DataFrame) -> DataFrame:
    """F4."""
    return _impact_dist(bi, "impact_theme", "impact_theme")


def impact_priority_distribution(bi: DataFrame) -> DataFrame:
    """F5."""
    return _impact_dist(bi, "impact_priority", order_case("impact_priority", PRIORITY_ORDER))


def impact_null_labels(bi: DataFrame) -> DataFrame:
    """pairs with a missing impact label (expected empty)."""
    return bi.where("impact_theme IS NULL OR impact_priority IS NULL")


def impact_master(bi: DataFrame) -> DataFrame:
    """the impact export by priority, impact units, units sold."""
    return sql(f"SELECT * FROM {{bi}} ORDER BY {_BY_URGENCY}", bi=bi)


def impact_overall(bi: DataFrame) -> DataFrame:
    """F8: one row of portfolio totals by theme and priority."""
    excess = f"impact_theme = {lit(L.THEME_EXCESS)}"
    service = f"impact_theme = {lit(L.THEME_SERVICE)}"
    high = f"impact_priority = {lit(L.PRIORITY_HIGH)}"
    share = round_half_up(
        f"100.0D * {sum_if(excess, 'total_units_sold')} / CAST(NULLIF(sum(total_units_sold), 0) AS DOUBLE)", 2
    )
    return sql(
        f"""
SELECT count(*) AS total_sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  {count_if(excess)} AS excess_item_count,
  {sum_if(excess, 'total_units_sold')} AS units_sold_in_excess_items,
  {sum_if(excess, 'primary_impact_units_proxy', 'DECIMAL(38,6)')} AS excess_units_proxy_total,
  {count_if(service)} AS service_risk_item_count,
  {sum_if(service, 'total_units_sold')} AS units_sold_in_service_risk_items,
  {sum_if(service, 'primary_impact_units_proxy', 'DECIMAL(38,6)')} AS at_risk_units_proxy_total,
  {count_if(f"impact_theme = {lit(L.THEME_BURDEN)}")} AS operational_burden_item_count,
  {count_if(high)} AS high_priority_item_count,
  {sum_if(high, 'primary_impact_units_proxy', 'DECIMAL(38,6)')} AS high_priority_impact_units_proxy,
  {share} AS sales_share_in_excess_items_pct
FROM {{bi}}
""",
        bi=bi,
    )


def impact_theme_summary(bi: DataFrame) -> DataFrame:
    """F9."""
    return sql(
        f"""
SELECT impact_theme, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  CAST(sum(primary_impact_units_proxy) AS DECIMAL(38,6)) AS total_primary_impact_units_proxy,
  {round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days,
  {round_half_up('avg(wape)', 4)} AS avg_wape,
  {round_half_up('avg(order_day_pct)', 2)} AS avg_order_day_pct
FROM {{bi}} GROUP BY impact_theme ORDER BY impact_theme
""",
        bi=bi,
    )


def category_impact_summary(bi: DataFrame) -> DataFrame:
    """F10."""
    return _impact_dist(bi, "category_clean, impact_theme", "category_clean, impact_theme")


def region_impact_summary(bi: DataFrame) -> DataFrame:
    """F11."""
    return _impact_dist(bi, "region_clean, impact_theme", "region_clean, impact_theme")


def top_impact_items(bi: DataFrame) -> DataFrame:
    """every non-Monitor pair, most urgent first."""
    return sql(
        f"""
SELECT store_id, product_id, category_clean, region_clean, total_units_sold,
  primary_impact_units_proxy,
  {round_half_up('primary_impact_vs_sales_ratio', 4)} AS primary_impact_vs_sales_ratio,
  avg_cover_days, order_day_pct, wape, policy_status,
  reorder_behavior_assessment, lead_time_behavior_proxy, impact_theme, impact_priority
FROM {{bi}}
WHERE impact_theme <> {lit(L.THEME_MONITOR)}
ORDER BY {_BY_URGENCY}
""",
        bi=bi,
    )
