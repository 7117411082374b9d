"""SKU-store segmentation: ABC, velocity, forecast quality, stock position."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise import config as L
from shelfwise.config import DEFAULT, Thresholds
from shelfwise.functions import lit, num, order_case, pct, round_half_up, select_list, sql
from shelfwise.operators.rollup import JOIN_KEYS, SUMMARY_COLUMNS, UNROUNDED_DOUBLES, exact
from shelfwise.plans.global_order import Key, global_orders, ntile

SEGMENT_EXTRA = [
    "units_sales_share", "cumulative_units_share", "velocity_tile", "forecast_tile",
    "abc_segment", "velocity_segment", "forecast_segment", "inventory_position_segment",
]
SEGMENT_COLUMNS = SUMMARY_COLUMNS + SEGMENT_EXTRA
SEGMENT_LABELS = SEGMENT_EXTRA[4:]

VELOCITY_ORDER = [L.VELOCITY_FAST, L.VELOCITY_MEDIUM, L.VELOCITY_SLOW]
FORECAST_ORDER = [L.FORECAST_GOOD, L.FORECAST_MODERATE, L.FORECAST_POOR]
_TIE = [Key("product_id"), Key("store_id")]


def position_label(t: Thresholds = DEFAULT) -> str:
    """C4h: stock position from unrounded pair rates."""
    return f"""CASE WHEN avg_cover_days < {num(t.low_cover_days)} OR low_cover_rate >= {num(t.low_cover_rate)}
         THEN {lit(L.POSITION_UNDER)}
       WHEN avg_cover_days > {num(t.high_cover_days)} OR high_cover_rate >= {num(t.high_cover_rate)}
         THEN {lit(L.POSITION_OVER)}
       ELSE {lit(L.POSITION_BALANCED)} END AS inventory_position_segment"""


def positions(rollup: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The pair rollup with its stock position: needs no whole-table ordering."""
    return sql(f"SELECT *, {position_label(t)} FROM {{r}}", r=rollup)


def inventory_segments(
    rollup: DataFrame, buckets: int, t: Thresholds = DEFAULT, registry: list[str] | None = None
) -> DataFrame:
    """C4: pair rollup + sales shares, tiles and the four segment labels.

    The cumulative share and both tiles are whole-table orderings; all
    three come from one :func:`global_orders` pass (range buckets over
    the full composite keys, per-bucket windows, broadcast bucket
    offsets), never from a single-partition window.  Ties are broken by
    (product, store).  ``buckets`` comes from the caller's exact count
    of pairs.
    """
    ranks = global_orders(
        rollup,
        {
            "sales": [Key("total_units_sold", desc=True, nulls_first=True), *_TIE],
            "velocity": [Key("avg_daily_units_sold", desc=True, nulls_first=False), *_TIE],
            "forecast": [Key("wape", nulls_first=False), *_TIE],
        },
        keys=JOIN_KEYS,  # the rollup is unique on (store, product)
        buckets=buckets,
        sums={"sales": "total_units_sold"},
        name="segments",
        registry=registry,
    )
    rest = [c for c in rollup.columns if c not in SUMMARY_COLUMNS]
    on = " AND ".join(f"r.{k} <=> k.{k}" for k in JOIN_KEYS)
    return sql(
        f"""
SELECT *,
  CASE WHEN cumulative_units_share <= {num(t.abc_a)} THEN {lit(L.ABC_A)}
       WHEN cumulative_units_share <= {num(t.abc_b)} THEN {lit(L.ABC_B)}
       ELSE {lit(L.ABC_C)} END AS abc_segment,
  CASE velocity_tile WHEN 1 THEN {lit(L.VELOCITY_FAST)} WHEN 2 THEN {lit(L.VELOCITY_MEDIUM)}
       ELSE {lit(L.VELOCITY_SLOW)} END AS velocity_segment,
  CASE forecast_tile WHEN 1 THEN {lit(L.FORECAST_GOOD)} WHEN 2 THEN {lit(L.FORECAST_MODERATE)}
       ELSE {lit(L.FORECAST_POOR)} END AS forecast_segment,
  {position_label(t)}
FROM (
  SELECT {', '.join('r.' + c for c in SUMMARY_COLUMNS)},
    CAST(r.total_units_sold AS DOUBLE) / CAST(NULLIF(k.total_sales, 0) AS DOUBLE) AS units_sales_share,
    CAST(k.running_sales AS DOUBLE) / CAST(NULLIF(k.total_sales, 0) AS DOUBLE) AS cumulative_units_share,
    {ntile(L.TILES, 'k.rn_velocity', 'k.n_velocity')} AS velocity_tile,
    {ntile(L.TILES, 'k.rn_forecast', 'k.n_forecast')} AS forecast_tile
    {''.join(', r.' + c for c in rest)}
  FROM {{rollup}} r JOIN {{ranks}} k ON {on}
)
""",
        rollup=rollup,
        ranks=ranks,
    )


def segments_view(seg: DataFrame, exact_digits: int | None = 10) -> DataFrame:
    """C4 as exposed: the segment columns, unrounded averages cut to 10 digits."""
    return seg.selectExpr(*[exact(n, exact_digits) if n in UNROUNDED_DOUBLES else n for n in SEGMENT_COLUMNS])


_BY_SALES = "total_units_sold DESC NULLS FIRST, product_id, store_id"


def segments_preview(seg: DataFrame) -> DataFrame:
    """Twelve columns by units sold."""
    return sql(
        f"""
SELECT store_id, product_id, category_clean, region_clean, total_units_sold,
  {exact('avg_daily_units_sold', 10)}, {exact('avg_cover_days', 10)}, {exact('wape', 10)},
  abc_segment, velocity_segment, forecast_segment, inventory_position_segment
FROM {{seg}} ORDER BY {_BY_SALES}
""",
        seg=seg,
    )


def abc_distribution(seg: DataFrame) -> DataFrame:
    """C6."""
    return sql(
        """
SELECT abc_segment, count(*) AS sku_store_count, CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold
FROM {seg} GROUP BY abc_segment ORDER BY abc_segment
""",
        seg=seg,
    )


def velocity_distribution(seg: DataFrame) -> DataFrame:
    """C7."""
    return sql(
        f"""
SELECT velocity_segment, count(*) AS sku_store_count,
  {round_half_up('avg(avg_daily_units_sold)', 2)} AS avg_daily_units_sold
FROM {{seg}} GROUP BY velocity_segment ORDER BY {order_case('velocity_segment', VELOCITY_ORDER)}
""",
        seg=seg,
    )


def forecast_distribution(seg: DataFrame) -> DataFrame:
    """C8."""
    return sql(
        f"""
SELECT forecast_segment, count(*) AS sku_store_count, {round_half_up('avg(wape)', 4)} AS avg_wape
FROM {{seg}} GROUP BY forecast_segment ORDER BY {order_case('forecast_segment', FORECAST_ORDER)}
""",
        seg=seg,
    )


def position_distribution(seg: DataFrame) -> DataFrame:
    """C9."""
    return sql(
        f"""
SELECT inventory_position_segment, count(*) AS sku_store_count,
  {round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days,
  {pct('avg(low_cover_rate)')} AS avg_low_cover_pct,
  {pct('avg(high_cover_rate)')} AS avg_high_cover_pct
FROM {{seg}} GROUP BY inventory_position_segment ORDER BY inventory_position_segment
""",
        seg=seg,
    )


def segment_null_labels(seg: DataFrame) -> DataFrame:
    """Pairs with a missing label (expected empty)."""
    return segments_view(seg).where(" OR ".join(f"{n} IS NULL" for n in SEGMENT_LABELS))


def segment_master(seg: DataFrame) -> DataFrame:
    """C11: the rounded segment export."""
    r = round_half_up
    cols = [
        "store_id", "product_id", "category_clean", "region_clean", "total_units_sold",
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
        *SEGMENT_LABELS,
    ]
    return sql(f"SELECT {select_list(cols)} FROM {{seg}} ORDER BY {_BY_SALES}", seg=seg)


def _segment_summary(seg: DataFrame, label: str, order: str) -> DataFrame:
    return sql(
        f"""
SELECT {label}, count(*) AS sku_store_count,
  CAST(sum(total_units_sold) AS BIGINT) AS total_units_sold,
  {round_half_up('avg(avg_cover_days)', 2)} AS avg_cover_days,
  {round_half_up('avg(wape)', 4)} AS avg_wape,
  CAST(sum(total_at_risk_units_proxy) AS DECIMAL(38,6)) AS total_at_risk_units_proxy,
  CAST(sum(total_excess_units_proxy) AS DECIMAL(38,6)) AS total_excess_units_proxy
FROM {{seg}} GROUP BY {label} ORDER BY {order}
""",
        seg=seg,
    )


def abc_summary(seg: DataFrame) -> DataFrame:
    """C12."""
    return _segment_summary(seg, "abc_segment", "abc_segment")


def velocity_summary(seg: DataFrame) -> DataFrame:
    """C13."""
    return _segment_summary(seg, "velocity_segment", order_case("velocity_segment", VELOCITY_ORDER))


def forecast_summary(seg: DataFrame) -> DataFrame:
    """C14."""
    return _segment_summary(seg, "forecast_segment", order_case("forecast_segment", FORECAST_ORDER))


def position_summary(seg: DataFrame) -> DataFrame:
    """C15."""
    return _segment_summary(seg, "inventory_position_segment", "inventory_position_segment")
