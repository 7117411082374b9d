"""Bucketed whole-table ordering equals Spark's own single-partition windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from shelfwise.plans.global_order import Key, global_orders, ntile

SCHEMA = T.StructType(
    [
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("v", T.LongType()),
        T.StructField("x", T.DoubleType()),
    ]
)


def _rows(n: int, seed: int):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        v = rnd.choice([None, 0, 0, 0, 1, 5, 7, 7, 100]) if n > 3 else rnd.choice([3, 3, None])
        x = rnd.choice([None, 0.5, 0.5, 1.25, 2.0, 9.75])
        out.append((f"p{rnd.randint(0, 3)}", f"s{i:04d}", v, x))
    return out


@pytest.mark.parametrize(
    "n,buckets,seed", [(1, 1, 1), (2, 3, 2), (3, 2, 3), (7, 3, 4), (50, 4, 5), (301, 6, 6), (120, 1, 8)]
)
def test_matches_window_functions(spark, n, buckets, seed):
    df = spark.createDataFrame(_rows(n, seed), SCHEMA)
    tie = [Key("a"), Key("b")]
    ranks = global_orders(
        df,
        {
            "v": [Key("v", desc=True, nulls_first=True), *tie],
            "x": [Key("x", desc=True, nulls_first=False), *tie],
            "y": [Key("x", nulls_first=False), *tie],
        },
        keys=["a", "b"],
        buckets=buckets,
        sums={"v": "v"},
    )
    ranks.createOrReplaceTempView("ranks")
    df.createOrReplaceTempView("src")
    got = spark.sql(
        f"""SELECT a, b, rn_v, running_v, total_v, n_v,
                   {ntile(3, 'rn_x', 'n_x')} AS tx, {ntile(3, 'rn_y', 'n_y')} AS ty
            FROM ranks"""
    ).collect()
    want = spark.sql(
        """SELECT a, b,
             row_number() OVER (ORDER BY v DESC NULLS FIRST, a, b) AS rn_v,
             sum(v) OVER (ORDER BY v DESC NULLS FIRST, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               AS running_v,
             sum(v) OVER () AS total_v,
             count(*) OVER () AS n_v,
             ntile(3) OVER (ORDER BY x DESC NULLS LAST, a, b) AS tx,
             ntile(3) OVER (ORDER BY x ASC NULLS LAST, a, b) AS ty
           FROM src"""
    ).collect()
    norm = lambda rows: sorted(tuple(r) for r in rows)
    assert norm(got) == norm(want)


def test_tiles_balanced(spark):
    for n in range(1, 12):
        df = spark.createDataFrame([(f"k{i:02d}", None, 1, 1.0) for i in range(n)], SCHEMA)
        ranks = global_orders(df, {"x": [Key("x"), Key("a")]}, keys=["a"], buckets=2)
        tiles = [r[0] for r in ranks.selectExpr(f"{ntile(3, 'rn_x', 'n_x')} AS t").collect()]
        sizes = [tiles.count(t) for t in set(tiles)]
        assert max(sizes) - min(sizes) <= 1
        assert sorted(set(tiles)) == list(range(1, min(n, 3) + 1))
