"""SQL expression builders shared by every operator.

Operators are written as Spark SQL text (``spark.sql`` with DataFrame
arguments): Catalyst sees exactly the plan the Column API would build,
while the driver makes one call per stage instead of one per
expression node.  These helpers return SQL fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def sql(text: str, **frames: DataFrame) -> DataFrame:
    """Run ``text`` with ``{name}`` placeholders bound to DataFrames."""
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(text, **frames)


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def num(x: float | int) -> str:
    """A numeric literal compared as DOUBLE (never a DECIMAL literal)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def round_half_up(expr: str, scale: int) -> str:
    """Decimal half-away-from-zero rounding of a double, returned as DOUBLE.

    ``round`` on a binary double can land on the wrong side of a .5
    boundary (23/40 -> 0.57); going through DECIMAL(38,10) rounds the
    printed decimal value like a numeric column would.
    """
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def safe_div(num_expr: str, den_expr: str) -> str:
    """``num / den`` as DOUBLE, NULL when ``den`` is 0 (never raises under ANSI)."""
    return f"(CAST({num_expr} AS DOUBLE) / CAST(NULLIF({den_expr}, 0) AS DOUBLE))"


def pct(rate_expr: str, scale: int = 2) -> str:
    """A 0..1 rate shown as a rounded percentage."""
    return round_half_up(f"({rate_expr}) * 100.0D", scale)


def flag(cond: str) -> str:
    """0/1 INT flag; a NULL condition counts as 0."""
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def count_if(cond: str) -> str:
    return f"CAST(SUM({flag(cond)}) AS BIGINT)"


def sum_if(cond: str, value: str, kind: str = "BIGINT") -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN {value} ELSE 0 END) AS {kind})"


def modal(label: str, count: str) -> str:
    """Aggregate: the most frequent non-null label, ties to the smallest."""
    return f"min(CASE WHEN {label} IS NOT NULL THEN named_struct('neg', -{count}, 'label', {label}) END).label"


def presented(df: DataFrame) -> DataFrame:
    """Exact decimals shown as doubles."""
    if not any(t.startswith("decimal") for _, t in df.dtypes):
        return df
    return df.selectExpr(*[f"CAST(`{n}` AS DOUBLE) AS `{n}`" if t.startswith("decimal") else f"`{n}`" for n, t in df.dtypes])


def order_case(col: str, ordered: list[str]) -> str:
    """Position of a label in a presentation order (others last)."""
    whens = " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(ordered, start=1))
    return f"CASE {col} {whens} ELSE {len(ordered) + 1} END"


def select_list(items: list[str]) -> str:
    return ",\n  ".join(items)
