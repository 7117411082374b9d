"""Reorder, safety-stock and lead-time assessment.

Unlike the policy diagnosis, these rules test the *rounded* base
columns (``low_cover_pct >= 20`` on a value already rounded to two
decimals), exactly as the published view does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise import config as L
from shelfwise.config import DEFAULT, Thresholds
from shelfwise.functions import lit, num, round_half_up, select_list, sql
from shelfwise.operators.cadence import CADENCE_COLUMNS
from shelfwise.operators.rollup import REPLENISHMENT_COLUMNS, replenishment_columns

# fixed values: the published column lists
ASSESSMENT_LABELS = [
    "reorder_behavior_assessment", "safety_stock_behavior_assessment",
    "lead_time_behavior_proxy", "demand_variability_band",
]
ASSESSMENT_COLUMNS = [*REPLENISHMENT_COLUMNS, *CADENCE_COLUMNS, *ASSESSMENT_LABELS]


def assessment_labels(t: Thresholds = DEFAULT) -> list[str]:
    """The four labels over rounded base columns and rounded cadence columns."""
    late = (
        f"(avg_cover_days < {num(t.low_cover_days)} OR low_cover_pct >= {num(t.low_cover_pct)}"
        f" OR zero_inventory_pct >= {num(t.zero_inventory_pct)})"
    )
    early = f"(avg_cover_days > {num(t.high_cover_days)} OR high_cover_pct >= {num(t.high_cover_pct)})"
    volatile = (
        f"(demand_cv > {num(t.cv_high)} OR wape > {num(t.wape_poor)}"
        f" OR abs(forecast_bias) > {num(t.bias_abs)})"
    )
    return [
        f"""CASE WHEN {late} THEN {lit(L.TRIGGER_LATE)}
       WHEN {early} THEN {lit(L.TRIGGER_EARLY)}
       ELSE {lit(L.TRIGGER_OK)} END AS reorder_behavior_assessment""",
        f"""CASE WHEN {volatile} AND {late} THEN {lit(L.BUFFER_INSUFFICIENT)}
       WHEN demand_cv <= {num(t.cv_medium)} AND wape <= {num(t.wape_good)} AND {early}
         THEN {lit(L.BUFFER_EXCESSIVE)}
       WHEN {volatile} THEN {lit(L.BUFFER_REVIEW)}
       ELSE {lit(L.BUFFER_OK)} END AS safety_stock_behavior_assessment""",
        f"""CASE WHEN order_day_pct >= {num(t.continuous_order_day_pct)}
            AND coalesce(avg_days_between_orders, 1.0D) <= {num(t.continuous_gap_days)}
         THEN {lit(L.CADENCE_CONTINUOUS)}
       WHEN coalesce(stddev_days_between_orders, 0.0D) > {num(t.irregular_gap_stddev)}
         THEN {lit(L.CADENCE_IRREGULAR)}
       WHEN coalesce(avg_days_between_orders, 0.0D) >= {num(t.sparse_gap_days)}
         THEN {lit(L.CADENCE_SPARSE)}
       ELSE {lit(L.CADENCE_MODERATE)} END AS lead_time_behavior_proxy""",
        f"""CASE WHEN demand_cv > {num(t.cv_high)} THEN {lit(L.VARIABILITY_HIGH)}
       WHEN demand_cv > {num(t.cv_medium)} THEN {lit(L.VARIABILITY_MEDIUM)}
       ELSE {lit(L.VARIABILITY_LOW)} END AS demand_variability_band""",
    ]


def cadence_join(pairs_sql: str) -> str:
    """``pairs_sql`` (a subquery) left-joined to ``{cad}`` on (store, product)."""
    cad = ", ".join(f"c.{n}" for n in CADENCE_COLUMNS)
    return f"""
SELECT p.*, {cad}
FROM ({pairs_sql}) p
LEFT JOIN {{cad}} c ON p.store_id = c.store_id AND p.product_id = c.product_id
"""


def reorder_assessment(rollup: DataFrame, cadence: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Replenishment base + cadence + four assessment labels."""
    base = f"SELECT {select_list(replenishment_columns())} FROM {{r}}"
    return sql(
        f"SELECT {select_list([*REPLENISHMENT_COLUMNS, *CADENCE_COLUMNS, *assessment_labels(t)])} "
        f"FROM ({cadence_join(base)})",
        r=rollup,
        cad=cadence,
    )


_BY_SALES = "total_units_sold DESC NULLS FIRST, product_id, store_id"


def assessment_row_count(ra: DataFrame) -> DataFrame:
    """E5."""
    return sql("SELECT count(*) AS assessment_rows FROM {ra}", ra=ra)


def assessment_top20(ra: DataFrame, n: int = 20) -> DataFrame:
    """E6."""
    return sql(f"SELECT * FROM {{ra}} ORDER BY {_BY_SALES} LIMIT {n}", ra=ra)


def _dist(ra: DataFrame, label: str, *extra: str) -> DataFrame:
    items = [label, "count(*) AS sku_store_count", "CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold", *extra]
    return sql(f"SELECT {select_list(items)} FROM {{ra}} GROUP BY {label} ORDER BY {label}", ra=ra)


def reorder_distribution(ra: DataFrame) -> DataFrame:
    """E7."""
    return _dist(ra, "reorder_behavior_assessment")


def safety_stock_distribution(ra: DataFrame) -> DataFrame:
    """E8."""
    return _dist(ra, "safety_stock_behavior_assessment")


def lead_time_distribution(ra: DataFrame) -> DataFrame:
    """E9."""
    return _dist(ra, "lead_time_behavior_proxy")


def variability_distribution(ra: DataFrame) -> DataFrame:
    """E10."""
    return _dist(ra, "demand_variability_band", f"{round_half_up('avg(demand_cv)', 4)} AS avg_demand_cv")


def assessment_null_labels(ra: DataFrame) -> DataFrame:
    """Pairs with a missing assessment label (expected empty)."""
    return ra.where(" OR ".join(f"{n} IS NULL" for n in ASSESSMENT_LABELS))


def assessment_master(ra: DataFrame) -> DataFrame:
    """Every assessment column by units sold."""
    return sql(f"SELECT * FROM {{ra}} ORDER BY {_BY_SALES}", ra=ra)


_PROXY_SUMS = [
    "CAST(sum(total_at_risk_units_proxy) AS DECIMAL(38,6)) AS total_at_risk_units_proxy",
    "CAST(sum(total_excess_units_proxy) AS DECIMAL(38,6)) AS total_excess_units_proxy",
]


def reorder_summary(ra: DataFrame) -> DataFrame:
    """E13."""
    return _dist(
        ra, "reorder_behavior_assessment",
        f"{round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days",
        f"{round_half_up('avg(low_cover_pct)', 2)} AS avg_low_cover_pct",
        f"{round_half_up('avg(high_cover_pct)', 2)} AS avg_high_cover_pct",
        *_PROXY_SUMS,
    )


def safety_stock_summary(ra: DataFrame) -> DataFrame:
    """E14."""
    return _dist(
        ra, "safety_stock_behavior_assessment",
        f"{round_half_up('avg(demand_cv)', 4)} AS avg_demand_cv",
        f"{round_half_up('avg(wape)', 4)} AS avg_wape",
        f"{round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days",
        *_PROXY_SUMS,
    )


def lead_time_summary(ra: DataFrame) -> DataFrame:
    """E15."""
    return _dist(
        ra, "lead_time_behavior_proxy",
        f"{round_half_up('avg(order_day_pct)', 2)} AS avg_order_day_pct",
        f"{round_half_up('avg(avg_days_between_orders)', 2)} AS avg_days_between_orders",
        f"{round_half_up('avg(stddev_days_between_orders)', 2)} AS avg_stddev_days_between_orders",
    )


def category_assessment_summary(ra: DataFrame) -> DataFrame:
    """Category x trigger x buffer."""
    keys = "category_clean, reorder_behavior_assessment, safety_stock_behavior_assessment"
    return sql(
        f"""
SELECT {keys}, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold, {', '.join(_PROXY_SUMS)}
FROM {{ra}} GROUP BY {keys} ORDER BY {keys}
""",
        ra=ra,
    )


REVIEW_COLUMNS = [
    "store_id", "product_id", "category_clean", "region_clean",
    "total_units_sold", "total_units_ordered", "avg_daily_demand", "demand_cv",
    "avg_cover_days", "low_cover_pct", "high_cover_pct", "zero_inventory_pct",
    "order_day_pct", "wape", "forecast_bias",
    "avg_days_between_orders", "stddev_days_between_orders",
    *ASSESSMENT_LABELS,
]


def review_priority_items(ra: DataFrame) -> DataFrame:
    """Pairs whose trigger or buffer is not in the normal band."""
    return sql(
        f"""
SELECT {', '.join(REVIEW_COLUMNS)} FROM {{ra}}
WHERE reorder_behavior_assessment <> {lit(L.TRIGGER_OK)}
   OR safety_stock_behavior_assessment <> {lit(L.BUFFER_OK)}
ORDER BY {_BY_SALES}
""",
        ra=ra,
    )
