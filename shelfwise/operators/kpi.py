"""KPI layer: row-level measures and rollups at six grains."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.functions import modal, num, pct, round_half_up, safe_div, select_list, sql

KPI_BASE_COLUMNS = [
    "date", "store_id", "product_id", "category_clean", "region_clean",
    "inventory_level", "units_sold", "units_ordered", "demand_forecast_clean",
    "forecast_error", "abs_forecast_error", "cover_days",
    "low_cover_flag", "high_cover_flag", "zero_inventory_flag",
    "at_risk_units_proxy", "excess_units_proxy",
]


def kpi_base(clean: DataFrame, low_cover_days: float = 1.0, high_cover_days: float = 7.0) -> DataFrame:
    """Per-row forecast error, stock cover, cover flags and unit proxies.

    ``clean`` may lack ``category_clean``/``region_clean`` (rollups that do
    not need the labels skip the lookup joins); they are then omitted.
    Cover is ``inventory / forecast`` divided through ``nullif``: the two
    cover flags stay safe from ANSI divide-by-zero even after common
    subexpression elimination hoists the division out of the CASE.
    """
    keep = [n for n in KPI_BASE_COLUMNS[:9] if n in clean.columns]
    if "category_clean" not in keep:
        keep += ["category", "region"]  # raw labels, for rollups that pick the canonical ones themselves
    # the days of stock that are not excess, as an exact decimal
    cover_cap = f"CAST({float(high_cover_days)!r} AS DECIMAL(10,4))"
    cover = f"CASE WHEN demand_forecast_clean > 0 THEN {safe_div('inventory_level', 'demand_forecast_clean')} END"
    return sql(
        f"""
SELECT {', '.join(keep)},
  forecast_error,
  abs(forecast_error) AS abs_forecast_error,
  cover_days,
  CASE WHEN cover_days < {num(low_cover_days)} THEN 1 ELSE 0 END AS low_cover_flag,
  CASE WHEN cover_days > {num(high_cover_days)} THEN 1 ELSE 0 END AS high_cover_flag,
  CASE WHEN inventory_level = 0 THEN 1 ELSE 0 END AS zero_inventory_flag,
  greatest(demand_forecast_clean - inventory_level, 0) AS at_risk_units_proxy,
  greatest(inventory_level - {cover_cap} * demand_forecast_clean, 0) AS excess_units_proxy
FROM (
  SELECT *, demand_forecast_clean - units_sold AS forecast_error, {cover} AS cover_days
  FROM {{clean}}
)
""",
        clean=clean,
    )


# Mergeable partial sums of M1-M12: a rollup by id combines these exactly
# (integer sums) or up to summation order (the cover-days sum).
_PARTIALS = [
    "count(*) AS n",
    "sum(units_sold) AS sold",
    "sum(inventory_level) AS inv_sum",
    "count(inventory_level) AS inv_n",
    "sum(units_ordered) AS ordered",
    "sum(cover_days) AS cover_sum",
    "count(cover_days) AS cover_n",
    "sum(low_cover_flag) AS low_n",
    "sum(high_cover_flag) AS high_n",
    "sum(zero_inventory_flag) AS zero_n",
    "sum(abs_forecast_error) AS abs_err",
    "sum(forecast_error) AS err",
    "sum(at_risk_units_proxy) AS at_risk",
    "sum(excess_units_proxy) AS excess",
]


_MERGED = [f"sum({p.split(' AS ')[1]}) AS {p.split(' AS ')[1]}" for p in _PARTIALS]


def is_merged(rows: DataFrame) -> bool:
    """Whether ``rows`` are partial sums already (a grain of :func:`kpi_grains`), not KPI base rows."""
    return "cover_n" in rows.columns


def _partials(rows: DataFrame) -> list[str]:
    return _MERGED if is_merged(rows) else _PARTIALS


def kpi_cube(kb: DataFrame) -> DataFrame:
    """Partial sums per month, pair and raw labels: the one pass over the fact that every KPI grain can be merged from."""
    return sql(
        f"""
SELECT trunc(date, 'MM') AS month, store_id, region, product_id, category, max(date) AS last_date, {', '.join(_PARTIALS)}
FROM {{kb}}
GROUP BY trunc(date, 'MM'), store_id, region, product_id, category
""",
        kb=kb,
    )


def kpi_grains(cube: DataFrame) -> DataFrame:
    """The cube merged in one pass to the grains ``all``, ``month``, ``store`` (with raw region) and ``product`` (with raw category).

    Canonical labels are picked from the raw labels of the last two, so the
    KPI tables by region, category, store and product need no other input.
    """
    return sql(
        f"""
SELECT CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(store_id) = 0 THEN 'store' WHEN grouping(product_id) = 0 THEN 'product' ELSE 'all' END AS grain,
  month, store_id, region, product_id, category, max(last_date) AS last_date, {', '.join(_MERGED)}
FROM {{cube}}
GROUP BY GROUPING SETS ((), (month), (store_id, region), (product_id, category))
""",
        cube=cube,
    )


def kpi_measures(merge: bool) -> list[str]:
    """M1-M12, the measure list of every KPI grain, over partial sums that are still to be merged or already are."""

    def t(name: str) -> str:
        return f"sum({name})" if merge else name

    return [
        f"CAST({t('sold')} AS BIGINT) AS total_units_sold",
        f"{round_half_up(safe_div(t('inv_sum'), t('inv_n')), 2)} AS avg_inventory_level",
        f"CAST({t('ordered')} AS BIGINT) AS total_units_ordered",
        f"{round_half_up(safe_div(t('ordered'), t('sold')), 2)} AS replenishment_to_sales_ratio",
        f"{round_half_up(safe_div(t('cover_sum'), t('cover_n')), 2)} AS avg_cover_days",
        f"{pct(safe_div(t('low_n'), t('n')))} AS low_cover_pct",
        f"{pct(safe_div(t('high_n'), t('n')))} AS high_cover_pct",
        f"{pct(safe_div(t('zero_n'), t('n')))} AS zero_inventory_pct",
        f"{round_half_up(safe_div(t('abs_err'), t('sold')), 4)} AS wape",
        f"{round_half_up(safe_div(t('err'), t('sold')), 4)} AS forecast_bias",
        f"CAST({t('at_risk')} AS DECIMAL(38,6)) AS total_at_risk_units_proxy",
        f"CAST({t('excess')} AS DECIMAL(38,6)) AS total_excess_units_proxy",
    ]


def _rollup(kb: DataFrame, keys: list[str], key_exprs: list[str] | None = None, order: str | None = None) -> DataFrame:
    key_exprs = key_exprs or keys
    named = [f"{e} AS {k}" for e, k in zip(key_exprs, keys)]
    group = f"GROUP BY {', '.join(key_exprs)}" if keys else ""
    if order is None and keys:
        order = "total_units_sold DESC NULLS FIRST, " + ", ".join(keys)
    order_by = f"ORDER BY {order}" if order else ""
    # one row per key: the measures are plain expressions over its sums
    return sql(f"SELECT {select_list([*keys, *kpi_measures(merge=False)])} FROM (SELECT {select_list([*named, *_partials(kb)])} FROM {{kb}} {group}) {order_by}", kb=kb)


def kpi_overall(kb: DataFrame) -> DataFrame:
    """The twelve measures over all rows."""
    return _rollup(kb, [])


def kpi_monthly(kb: DataFrame) -> DataFrame:
    """Measures per calendar month."""
    return _rollup(kb, ["month"], None if is_merged(kb) else ["trunc(date, 'MM')"], order="month")


def kpi_by_label(kb: DataFrame, entity: str, label: str, keep_id: bool = False) -> DataFrame:
    """B7/B8/B10 from one scan, without joining labels to the fact.

    The rows are combined per (id, raw label); the id's canonical label is
    the one most of its rows carry, picked over those few rows, and the
    partial sums are merged per canonical label.
    """
    id_col, raw_label = ("product_id", "category") if entity == "product" else ("store_id", "region")
    keys = [id_col, label] if keep_id else [label]
    return sql(
        f"""
WITH per_label AS (
  SELECT {id_col}, {raw_label} AS raw_label, {', '.join(_partials(kb))} FROM {{kb}} GROUP BY {id_col}, {raw_label}
), per_id AS (
  SELECT {id_col}, {modal('raw_label', 'n')} AS {label}, {', '.join(_MERGED)} FROM per_label GROUP BY {id_col}
)
SELECT {select_list([*keys, *kpi_measures(merge=True)])}
FROM per_id
GROUP BY {', '.join(keys)}
ORDER BY total_units_sold DESC NULLS FIRST, {', '.join(keys)}
""",
        kb=kb,
    )


def kpi_store(kb: DataFrame) -> DataFrame:
    """B9."""
    return _rollup(kb, ["store_id"])


def _top_rows(kb: DataFrame, maps: DataFrame, where: str, order: str, n: int) -> DataFrame:
    """The first ``n`` KPI rows in an order; labels are looked up for those rows only."""
    top = sql(f"SELECT * FROM {{kb}} {where} ORDER BY {order} LIMIT {n}", kb=kb)
    named = [f"pm.label AS {c}" if c == "category_clean" else f"sm.label AS {c}" if c == "region_clean" else f"t.{c}" for c in KPI_BASE_COLUMNS]
    return sql(
        f"""
SELECT {', '.join(named)}
FROM {{top}} t
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'product') pm ON t.product_id = pm.id
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'store') sm ON t.store_id = sm.id
ORDER BY {order}
""",
        top=top,
        maps=maps,
    )


def kpi_base_preview(kb: DataFrame, maps: DataFrame, n: int = 20) -> DataFrame:
    """First rows of the KPI base in key order (top-k, not a sort)."""
    return _top_rows(kb, maps, "", "date, store_id, product_id", n)


def check_total_units_sold(clean: DataFrame) -> DataFrame:
    """Control total over the cleaned table."""
    return sql("SELECT CAST(sum(units_sold) AS BIGINT) AS total_units_sold FROM {t}", t=clean)


def check_total_units_ordered(clean: DataFrame) -> DataFrame:
    """B12."""
    return sql("SELECT CAST(sum(units_ordered) AS BIGINT) AS total_units_ordered FROM {t}", t=clean)


def check_flag_totals(kb: DataFrame) -> DataFrame:
    """Number of low-cover, high-cover and zero-inventory rows."""
    return sql(
        """
SELECT CAST(sum(low_cover_flag) AS BIGINT) AS low_cover_rows,
       CAST(sum(high_cover_flag) AS BIGINT) AS high_cover_rows,
       CAST(sum(zero_inventory_flag) AS BIGINT) AS zero_inventory_rows
FROM {kb}
""",
        kb=kb,
    )


def lowest_cover_rows(kb: DataFrame, maps: DataFrame, n: int = 20) -> DataFrame:
    """The n rows with the lowest defined cover (key tie-break)."""
    return _top_rows(kb, maps, "WHERE cover_days IS NOT NULL", "cover_days, date, store_id, product_id", n)


def highest_cover_rows(kb: DataFrame, maps: DataFrame, n: int = 20) -> DataFrame:
    """The n rows with the highest defined cover (key tie-break)."""
    return _top_rows(kb, maps, "WHERE cover_days IS NOT NULL", "cover_days DESC, date, store_id, product_id", n)


def forecast_error_stats(kb: DataFrame) -> DataFrame:
    """Range and mean of the forecast error."""
    return sql(
        f"""
SELECT min(forecast_error) AS min_forecast_error,
       max(forecast_error) AS max_forecast_error,
       {round_half_up('avg(forecast_error)', 10)} AS avg_forecast_error,
       min(abs_forecast_error) AS min_abs_forecast_error,
       max(abs_forecast_error) AS max_abs_forecast_error
FROM {{kb}}
""",
        kb=kb,
    )


def check_wape_bias(kb: DataFrame) -> DataFrame:
    """Global WAPE and forecast bias."""
    return sql(
        f"""
SELECT {round_half_up(safe_div('sum(abs_forecast_error)', 'sum(units_sold)'), 4)} AS wape,
       {round_half_up(safe_div('sum(forecast_error)', 'sum(units_sold)'), 4)} AS forecast_bias
FROM {{kb}}
""",
        kb=kb,
    )
