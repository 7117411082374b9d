"""Data audit, label maps, cleaning and quality flags (operators A2-A8, B1-B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.functions import count_if, flag, modal, select_list, sql
from shelfwise.sources.inventory import RAW_COLUMNS, REJECTED

KEY = ["date", "store_id", "product_id"]
CLEAN_COLUMNS = RAW_COLUMNS + ["category_clean", "region_clean", "demand_forecast_clean"]
# shown only: rows are compared by the three columns, which may hold the delimiter or NULL
ROW_KEY = "concat_ws('|', CAST(date AS STRING), store_id, product_id)"
# both (id, label) pairs of a row in one pass
LABELLED = "stack(2, 'product', product_id, category, 'store', store_id, region) AS (entity, id, label)"


def label_maps(raw: DataFrame) -> DataFrame:
    """A3 + A4 in one scan: canonical label per id, the most frequent one,
    ties to the smallest (entity, id, label).

    Two aggregations, no window: (id, label) counts are combined map-side,
    so an id that owns a third of all rows costs one partial row per task;
    the second step picks the modal label per id.  ``raw`` may already be
    grouped, with the rows of a group in a column ``n``.
    """
    n = "sum(n)" if "n" in raw.columns else "count(*)"
    carried = ", n" if "n" in raw.columns else ""
    return sql(
        f"""
SELECT entity, id, {modal('label', 'n')} AS label
FROM (
  SELECT entity, id, label, {n} AS n
  FROM (SELECT {LABELLED}{carried} FROM {{raw}})
  WHERE label IS NOT NULL
  GROUP BY entity, id, label
)
GROUP BY entity, id
""",
        raw=raw,
    )


def product_map(maps: DataFrame) -> DataFrame:
    """A3: product_id -> category_clean."""
    return sql(
        "SELECT id AS product_id, label AS category_clean FROM {m} WHERE entity = 'product'", m=maps
    )


def store_map(maps: DataFrame) -> DataFrame:
    """A4: store_id -> region_clean."""
    return sql("SELECT id AS store_id, label AS region_clean FROM {m} WHERE entity = 'store'", m=maps)


def clean_forecast(mode: str = "zero") -> str:
    """Negative forecasts are not demand: clip to 0 (default) or drop to NULL."""
    if mode == "zero":
        return "greatest(demand_forecast, 0)"
    if mode == "null":
        return "CASE WHEN demand_forecast >= 0 THEN demand_forecast END"
    raise ValueError(f"negative_forecast must be 'zero' or 'null', got {mode!r}")


def inventory_clean(raw: DataFrame, pmap: DataFrame, smap: DataFrame, negative_forecast: str = "zero") -> DataFrame:
    """A5: raw rows + category_clean, region_clean, demand_forecast_clean.

    Left joins keep every raw row (an id without a usable label gets
    NULL).  The maps are written tables of one row per id: the planner
    knows their bytes, broadcasts them below the session's threshold and
    otherwise joins by shuffle, where AQE splits a hot id.
    """
    df = raw.join(pmap, "product_id", "left").join(smap, "store_id", "left")
    return df.selectExpr(
        *RAW_COLUMNS,
        "category_clean",
        "region_clean",
        f"{clean_forecast(negative_forecast)} AS demand_forecast_clean",
    )


# A row key is (date, store, product).  Of the rows of a pair in 64 days, as many keys are distinct as bits are set in the
# mask of their days; rows without a date are one key.
_DAY = "datediff(CAST(date AS DATE), DATE'1970-01-01')"
_BLOCK = "floor(day / 64)"
_MASK = "bit_or(shiftleft(1L, CAST(pmod(day, 64) AS INT)))"
_DISTINCT = "CASE WHEN block IS NULL THEN 1 ELSE bit_count(days) END"


def crowded_blocks(raw: DataFrame) -> DataFrame:
    """(store_id, product_id, block) where some key occurs twice: combined map-side, a row per pair and 64 days is shuffled."""
    return sql(
        f"""
SELECT store_id, product_id, block
FROM (SELECT store_id, product_id, {_BLOCK} AS block, count(*) AS n, {_MASK} AS days
      FROM (SELECT store_id, product_id, {_DAY} AS day FROM {{raw}}) GROUP BY store_id, product_id, {_BLOCK})
WHERE n > {_DISTINCT}
""",
        raw=raw,
    )


def duplicate_keys(raw: DataFrame, crowded: DataFrame) -> DataFrame:
    """Row keys that occur more than once, with their multiplicity; only rows of ``crowded`` blocks are grouped by key."""
    keys = ", ".join(KEY)
    return sql(
        f"""
SELECT {keys}, count(*) AS key_rows
FROM (SELECT {keys}, {_BLOCK} AS block FROM (SELECT {keys}, {_DAY} AS day FROM {{raw}})) r
LEFT SEMI JOIN {{crowded}} c ON r.store_id <=> c.store_id AND r.product_id <=> c.product_id AND r.block <=> c.block
GROUP BY {keys} HAVING count(*) > 1
""",
        raw=raw,
        crowded=crowded,
    )


def quality_flags(clean: DataFrame, dup_keys: DataFrame) -> DataFrame:
    """The cleaned table with its row key and 12 quality flags."""
    bad = lambda n: f"{n} IS NULL OR {n} < 0"
    on = " AND ".join(f"c.{k} <=> d.{k}" for k in KEY)
    flagged = sql(
        f"SELECT c.*, CASE WHEN d.key_rows IS NOT NULL THEN 1 END AS _dup FROM {{c}} c LEFT JOIN {{d}} d ON {on}",
        c=clean.selectExpr("*", f"{ROW_KEY} AS Row_Key"),
        d=dup_keys,
    )
    return flagged.selectExpr(
        *CLEAN_COLUMNS,
        "Row_Key",
        "coalesce(_dup, 0) AS Duplicate_Flag",
        f"{flag(bad('inventory_level'))} AS Inventory_Invalid_Flag",
        f"{flag(bad('units_sold'))} AS UnitsSold_Invalid_Flag",
        f"{flag(bad('units_ordered'))} AS UnitsOrdered_Invalid_Flag",
        f"{flag(bad('demand_forecast'))} AS DemandForecast_Invalid_Flag",
        f"{flag(bad('price'))} AS Price_Invalid_Flag",
        # a discount may be stored as a fraction (0..1) or a percent (0..100)
        f"{flag(bad('discount') + ' OR discount > 100')} AS Discount_Invalid_Flag",
        f"{flag('holiday_promotion IS NULL OR holiday_promotion NOT IN (0, 1)')} AS HolidayPromo_Invalid_Flag",
        f"{flag(bad('competitor_pricing'))} AS CompetitorPrice_Invalid_Flag",
        f"{flag('demand_forecast < 0')} AS Negative_Forecast_Flag",
        f"{flag('NOT (category <=> category_clean)')} AS Category_Mismatch_Flag",
        f"{flag('NOT (region <=> region_clean)')} AS Region_Mismatch_Flag",
    )


def map_conflicts(raw: DataFrame) -> DataFrame:
    """Ids carrying more than one raw label (entity, entity_id, label_count)."""
    return sql(
        f"""
SELECT entity, id AS entity_id, count(*) AS label_count
FROM (SELECT DISTINCT entity, id, label FROM (SELECT {LABELLED} FROM {{raw}}) WHERE label IS NOT NULL)
GROUP BY entity, id
HAVING count(*) > 1
""",
        raw=raw,
    )


def clean_label_conflicts(clean: DataFrame) -> DataFrame:
    """A8 after cleaning: ids that still carry several canonical labels, or a row whose label is lost.  Expect no rows.

    Cleaning makes category a function of the product and region of the store;
    everything after it relies on that (a pair with two labels would be two
    rows of every pair view).  NULL counts as a label of its own here.
    """
    return sql(
        """
SELECT entity, id AS entity_id, count(*) AS label_count
FROM (
  SELECT DISTINCT entity, id, label
  FROM (SELECT stack(2, 'product', product_id, category_clean, 'store', store_id, region_clean) AS (entity, id, label) FROM {clean})
)
GROUP BY entity, id
HAVING count(*) > 1
""",
        clean=clean,
    )


def audit_pairs(raw: DataFrame) -> DataFrame:
    """Everything the audit needs, per (product, store): a pair-level table from one scan.

    Repeated keys are counted per block of 64 days, as the rows beyond the
    bits of the block's day mask; two steps by keys that contain each other,
    so the second adds no shuffle of the fact.
    """
    missing = " + ".join(flag(f"{n} IS NULL") for n in RAW_COLUMNS)
    rejected = REJECTED if REJECTED in raw.columns else "0"
    return sql(
        f"""
SELECT product_id, store_id, sum(n) AS n, sum(missing) AS missing, sum(rejected) AS rejected, sum(negative) AS negative,
  sum(n - {_DISTINCT}) AS repeated,
  min(category_lo) AS category_lo, max(category_hi) AS category_hi, min(region_lo) AS region_lo, max(region_hi) AS region_hi
FROM (
  SELECT product_id, store_id, {_BLOCK} AS block, count(*) AS n, sum({missing}) AS missing, sum({rejected}) AS rejected,
    {count_if('demand_forecast < 0')} AS negative, {_MASK} AS days,
    min(category) AS category_lo, max(category) AS category_hi, min(region) AS region_lo, max(region) AS region_hi
  FROM (SELECT *, {_DAY} AS day FROM {{raw}}) GROUP BY product_id, store_id, {_BLOCK}
)
GROUP BY product_id, store_id
""",
        raw=raw,
    )


def audit_summary(pairs: DataFrame) -> DataFrame:
    """A2: one row of audit counts; ``pairs`` is the written :func:`audit_pairs` table.

    ``rejected_cells`` counts cells whose content did not fit the column's
    type; they are NULL in the table and so also among ``missing_values``.
    An id has several labels if its smallest and largest differ.
    """
    several = lambda lo, hi: f"min({lo}) <> max({hi})"
    return sql(
        f"""
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows,
  CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing_values,
  CAST(coalesce(sum(rejected), 0) AS BIGINT) AS rejected_cells,
  CAST(coalesce(sum(repeated), 0) AS BIGINT) AS duplicate_rows,
  CAST(coalesce(sum(negative), 0) AS BIGINT) AS negative_forecast_rows,
  (SELECT count(*) FROM (SELECT product_id FROM {{pairs}} GROUP BY product_id HAVING {several('category_lo', 'category_hi')}))
    AS products_with_multiple_categories,
  (SELECT count(*) FROM (SELECT store_id FROM {{pairs}} GROUP BY store_id HAVING {several('region_lo', 'region_hi')}))
    AS stores_with_multiple_regions
FROM {{pairs}}
""",
        pairs=pairs,
    )


def negative_forecast_rows(clean: DataFrame) -> DataFrame:
    """Rows whose raw forecast is negative (isolated, then clipped)."""
    return clean.where("demand_forecast < 0")


def kpi_null_check(unlabelled: DataFrame, maps: DataFrame) -> DataFrame:
    """B1: NULL counts of the nine columns the KPI layer relies on.

    Counted per (product, store) first; the labels are looked up on those
    rows, not on the fact.
    """
    own = ["date", "store_id", "product_id", "inventory_level", "units_sold", "units_ordered", "demand_forecast_clean"]
    total = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
    shown = [f"{total('null_' + c)} AS null_{c}" for c in own]
    shown[3:3] = [f"{total(flag(f'{m}.label IS NULL') + ' * p.n')} AS null_{c}" for m, c in (("pm", "category_clean"), ("sm", "region_clean"))]
    return sql(
        f"""
WITH p AS (
  SELECT product_id, store_id, count(*) AS n, {', '.join(f"{count_if(f'{c} IS NULL')} AS null_{c}" for c in own)}
  FROM {{rows}} GROUP BY product_id, store_id
)
SELECT {select_list(shown)}
FROM p
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'product') pm ON p.product_id = pm.id
LEFT JOIN (SELECT id, label FROM {{maps}} WHERE entity = 'store') sm ON p.store_id = sm.id
""",
        rows=unlabelled,
        maps=maps,
    )


def kpi_bad_numeric_rows(clean: DataFrame) -> DataFrame:
    """B2: rows with a negative stock, sales, order or cleaned forecast value."""
    return clean.where(
        "inventory_level < 0 OR units_sold < 0 OR units_ordered < 0 OR demand_forecast_clean < 0"
    )
