"""Sources of the daily store-product inventory table (``inventory_raw``)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# One row per (date, store_id, product_id).
RAW_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("inventory_level", T.LongType()),
        T.StructField("units_sold", T.LongType()),
        T.StructField("units_ordered", T.LongType()),
        T.StructField("demand_forecast", T.DecimalType(20, 6)),
        T.StructField("price", T.DoubleType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("weather_condition", T.StringType()),
        T.StructField("holiday_promotion", T.IntegerType()),
        T.StructField("competitor_pricing", T.DoubleType()),
        T.StructField("seasonality", T.StringType()),
    ]
)
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
# cells of a row that hold something the column's type cannot take
REJECTED = "rejected_cells"
# the text of a CSV line whose number of cells is not the header's
MALFORMED = "_malformed_line"

# Header spellings used by the original CSV export.
_CSV_HEADER = {
    "Date": "date",
    "Store_ID": "store_id",
    "Product_ID": "product_id",
    "Category": "category",
    "Region": "region",
    "Inventory_Level": "inventory_level",
    "Units_Sold": "units_sold",
    "Units_Ordered": "units_ordered",
    "Demand_Forecast": "demand_forecast",
    "Price": "price",
    "Discount": "discount",
    "Weather_Condition": "weather_condition",
    "Holiday_Promotion": "holiday_promotion",
    "Competitor_Pricing": "competitor_pricing",
    "Seasonality": "seasonality",
}


def _typed(column: str, kind: T.DataType) -> str:
    """A cell as its column's type, NULL where it does not fit; whole numbers only for counts."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        exact = f"try_cast({column} AS DECIMAL(38,10))"
        return f"CASE WHEN {exact} = floor({exact}) THEN try_cast({exact} AS {kind.simpleString()}) END"
    return f"try_cast({column} AS {kind.simpleString()})"


def _cells(df: DataFrame) -> list[tuple[T.StructField, str]]:
    """Each column of the schema with the source column that holds it."""
    present = set(df.columns)
    return [(f, next((h for h, n in _CSV_HEADER.items() if n == f.name and h in present), f.name)) for f in RAW_SCHEMA.fields]


def _misfit(field: T.StructField, src: str) -> str:
    return f"`{src}` IS NOT NULL AND ({_typed(f'`{src}`', field.dataType)}) IS NULL"


def conform(df: DataFrame) -> DataFrame:
    """Rename known header spellings and read every cell as its :data:`RAW_SCHEMA` type.

    A cell that does not fit becomes NULL and is counted in
    ``rejected_cells``, one count per row, which the audit adds up.  A CSV line
    with surplus or missing cells counts one more: what it holds is read, the
    surplus is not.  :func:`quarantine` shows all of them.
    """
    cells = _cells(df)
    exprs = [f"{_typed(f'`{src}`', f.dataType)} AS {f.name}" for f, src in cells]
    rejected = [f"CASE WHEN {_misfit(f, src)} THEN 1 ELSE 0 END" for f, src in cells]
    if MALFORMED in df.columns:
        rejected.append(f"CASE WHEN {MALFORMED} IS NOT NULL THEN 1 ELSE 0 END")
    return df.selectExpr(*exprs, f"{' + '.join(rejected)} AS {REJECTED}")


def _scan(spark: SparkSession, path: str, fmt: str, options: dict) -> DataFrame:
    """The source as it is; CSV cells as strings, with the text of lines that have too many or too few."""
    if fmt != "csv":
        return spark.read.options(**options).format(fmt).load(path)
    reader = spark.read.option("header", "true").options(**options)
    # strings, then cast: no schema-inference pass over the data, only the header is read here
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*reader.csv(path).columns, MALFORMED]])
    # every cell of a line is parsed, whichever columns a query needs: else a line's length would go unseen
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", "false").csv(path)


def quarantine(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """What :func:`read_inventory` rejects, a row each: file, column and cell; for a malformed line column is NULL and cell the line."""
    df = _scan(spark, path, fmt, options)
    found = [f"CASE WHEN {_misfit(f, src)} THEN named_struct('column', '{f.name}', 'cell', CAST(`{src}` AS STRING)) END" for f, src in _cells(df)]
    if MALFORMED in df.columns:
        found.append(f"CASE WHEN {MALFORMED} IS NOT NULL THEN named_struct('column', CAST(NULL AS STRING), 'cell', {MALFORMED}) END")
    rows = df.selectExpr("_metadata.file_path AS file", f"explode(filter(array({', '.join(found)}), x -> x IS NOT NULL)) AS r")
    return rows.selectExpr("file", "r.column", "r.cell")


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan a daily inventory table (Parquet, ORC or CSV with a header)."""
    return conform(_scan(spark, path, fmt, options))


# order lines of a task that groups them: what it sorts and combines stays near 200 MB at any input size
LINES_PER_TASK = 250_000


def line_partitions(lines: int, cores: int, lines_per_task: int = LINES_PER_TASK) -> int:
    """Tasks that group the order lines: by their number, and one a core at least."""
    return max(1, cores, math.ceil(lines / lines_per_task))


def inventory_from_tpch(spark: SparkSession, sf_dir: str, lines_per_task: int = LINES_PER_TASK) -> DataFrame:
    """Daily inventory rows derived from the TPC-H-like test tables.

    Store = supplier, product = part brand number, raw category = part
    type, raw region = the ordering customer's region (so both maps are
    inconsistent on purpose); ship dates are folded into a per-supplier
    span of 16, 40, 120 or 731 days so that every ordering cadence
    occurs.  See FIXTURES.md section 2.

    nation (25 rows) and region (5 rows) are fixed-size by the TPC-H
    spec, so broadcasting them is bounded at any scale factor; the
    other joins are left to the planner (sort-merge at scale).

    The joined lines move once more, to their store and product, in as many
    partitions as their exact number asks for: daily rows are combined there,
    and what groups them by pair next (pair sums, blocks, the KPI cube) finds
    them in place, so the wide partial sums are never shuffled.  From more than
    one such partition a core on, the lines meet their orders in as many tasks
    (the session's number of shuffle partitions at least), so what a task sorts
    does not grow with the input.
    """
    d = sf_dir.rstrip("/")

    def t(name: str) -> str:
        return f"parquet.`{d}/{name}.parquet`"

    span = "CASE s % 5 WHEN 0 THEN 16 WHEN 1 THEN 40 WHEN 2 THEN 731 ELSE 120 END"
    k = "((s * 7 + b * 3) % 10)"
    cores = spark.sparkContext.defaultParallelism
    n = line_partitions(spark.table(t("lineitem")).count(), cores, lines_per_task)
    # on the orders' side: the join takes over the larger of this and the session's number, without a shuffle of its own
    spread = f", REPARTITION({n}, o_orderkey)" if n > cores else ""
    return spark.sql(
        f"""
WITH geo AS (
  SELECT /*+ BROADCAST(r) */ n.n_nationkey, r.r_name
  FROM {t('nation')} n JOIN {t('region')} r ON n.n_regionkey = r.r_regionkey
), order_info AS (
  SELECT /*+ BROADCAST(geo){spread} */ o.o_orderkey, geo.r_name AS region, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent
  FROM {t('orders')} o
  JOIN {t('customer')} cu ON o.o_custkey = cu.c_custkey
  JOIN geo ON cu.c_nationkey = geo.n_nationkey
), line AS (
  SELECT concat('S', CAST(l.l_suppkey AS STRING)) AS store_id,
         concat('P', CAST(CAST(substr(p.p_brand, 7) AS INT) AS STRING)) AS product_id,
         p.p_type AS category,
         oi.region,
         CAST(l.l_quantity AS BIGINT) AS q,
         l.l_linenumber AS ln,
         CAST(round(l.l_tax * 100) AS BIGINT) AS tx,
         l.l_orderkey AS ok,
         p.p_retailprice AS rp,
         l.l_discount AS disc,
         oi.urgent,
         l.dn
  FROM (SELECT *, datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01') AS dn FROM {t('lineitem')}) l
  JOIN {t('part')} p ON l.l_partkey = p.p_partkey
  JOIN order_info oi ON l.l_orderkey = oi.o_orderkey
), placed AS (
  SELECT /*+ REPARTITION({n}, store_id, product_id) */ * FROM line
), named AS (
  SELECT *, CAST(substr(store_id, 2) AS BIGINT) AS s, CAST(substr(product_id, 2) AS INT) AS b FROM placed
), calc AS (
  SELECT *,
         CASE WHEN s % 3 = 0 THEN q + tx - 5 ELSE q + tx * 2 - 8 + (b % 4) * 3 END AS fc,
         dn % ({span}) AS d
  FROM named
), g AS (
  -- store_id and product_id name s and b; numbers first, so sorting the lines seldom compares names
  SELECT s, b, d, store_id, product_id,
         max(category) AS category,
         max(region) AS region,
         min(ok) AS min_ok,
         sum(q) AS sum_q,
         sum(q * (ln % 2)) AS sum_q_odd,
         sum(CASE WHEN ln = 1 THEN q ELSE 0 END) AS sum_q_first,
         sum(CASE WHEN ln <= 5 THEN q + 7 ELSE 0 END) AS sum_q_first5,
         sum(fc) AS fcst,
         max(rp) AS price,
         max(disc) AS discount,
         max(urgent) AS holiday_promotion,
         max(rp + tx) AS competitor_pricing
  FROM calc
  GROUP BY s, b, d, store_id, product_id
)
SELECT
  date_add(DATE'2022-01-01', CAST(d AS INT)) AS date,
  store_id,
  product_id,
  category,
  region,
  CAST(CASE WHEN {k} = 9 AND min_ok % 5 = 0 THEN 0
            WHEN {k} = 7 THEN sum_q div 2
            WHEN {k} = 8 AND min_ok % 2 = 0 THEN sum_q div 3
            WHEN {k} IN (5, 8) THEN sum_q * 9
            WHEN {k} = 6 THEN sum_q * 6
            ELSE sum_q * (2 + {k}) END AS BIGINT) AS inventory_level,
  CAST(sum_q AS BIGINT) AS units_sold,
  CAST(CASE WHEN ({span}) = 16 THEN sum_q + {k} % 3
            WHEN s % 7 = 3 THEN sum_q_odd
            WHEN s % 7 = 5 THEN sum_q_first * 3
            ELSE sum_q_first5 END AS BIGINT) AS units_ordered,
  CAST(fcst + 0.25BD * ((d + s + b) % 4) AS DECIMAL(20,6)) AS demand_forecast,
  CAST(price AS DOUBLE) AS price,
  CAST(discount AS DOUBLE) AS discount,
  CASE d % 4 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy' WHEN 2 THEN 'Cloudy' ELSE 'Snowy' END AS weather_condition,
  CAST(holiday_promotion AS INT) AS holiday_promotion,
  CAST(competitor_pricing AS DOUBLE) AS competitor_pricing,
  CASE (d div 91) % 4 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END AS seasonality
FROM g
"""
    )
