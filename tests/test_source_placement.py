"""The derived source combines order lines where their pair lives: pair-level steps over it shuffle nothing wide."""

from __future__ import annotations

import duckdb
import pytest

from shelfwise.operators import cadence, kpi, rollup
from shelfwise.pipeline import InventoryPipeline
from shelfwise.sources.inventory import inventory_from_tpch, line_partitions

STEPS = {
    "pair_sums": rollup.pair_sums,
    "pair_blocks": rollup.pair_blocks,
    "kpi_cube": kpi.kpi_cube,
    "order_blocks": cadence.order_blocks,
}


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("name", STEPS)
def test_pair_steps_add_no_shuffle_to_the_source(spark, sf_small, name):
    p = InventoryPipeline.from_tpch(spark, sf_small)
    rows = p.kpi_base(labels=False)
    step = STEPS[name](rows)
    grouped = [x for x in _exchanges(step) if "store_id" in x]
    assert len(grouped) == 1 and "REPARTITION_BY_NUM" in grouped[0], grouped
    assert len(_exchanges(step)) == len(_exchanges(rows))


def test_partitions_follow_the_lines(spark, sf_small):
    assert line_partitions(0, 4) == 4 and line_partitions(600_000, 12) == 12
    assert line_partitions(36_000_000, 12) == 144 and line_partitions(216_000_000, 12) == 864
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
    small = inventory_from_tpch(spark, sf_small, lines_per_task=lines // 10)
    number = line_partitions(lines, spark.sparkContext.defaultParallelism, lines // 10)
    assert any("product_id" in x and f", {number})" in x for x in _exchanges(small))
    assert sorted(small.collect()) == sorted(inventory_from_tpch(spark, sf_small).collect())


def test_lines_meet_their_orders_in_as_many_tasks(spark, sf_small):
    """What a task of the join sorts follows from the number of lines, not from the session's number of partitions alone."""
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").count()
    cores, session = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for asked in (cores + 3, session + 3):
            number = line_partitions(lines, cores, lines // asked)
            assert number > cores
            joined = [x for x in _exchanges(inventory_from_tpch(spark, sf_small, lines_per_task=lines // asked)) if "orderkey" in x]
            assert len(joined) == 2 and all(f", {max(number, session)})" in x for x in joined), joined
        few = [x for x in _exchanges(inventory_from_tpch(spark, sf_small, lines_per_task=lines)) if "orderkey" in x]
        assert few and not any("REPARTITION_BY_NUM" in x for x in few), few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_lines_are_sorted_by_numbers_before_names(spark, sf_small):
    plan = inventory_from_tpch(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[s#" in plan
    keys = next(x for x in plan.splitlines() if "SortAggregate(key=[s#" in x).split("key=[")[1].split("]")[0].split(", ")
    assert [k.split("#")[0] for k in keys] == ["s", "b", "d", "store_id", "product_id"]


def test_rows_without_a_supplier_stay_one_store_without_a_name(spark, tmp_path, sf_small):
    """Null and repeated keys are grouped as the numbers they name."""
    c = duckdb.connect()
    for t in ["region", "nation", "customer", "part", "orders"]:
        c.execute(f"COPY (SELECT * FROM '{sf_small}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    c.execute(
        f"""COPY (SELECT * EXCLUDE (i) REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey)
                 FROM '{sf_small}/lineitem.parquet', range(2) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"""
    )
    rows = inventory_from_tpch(spark, str(tmp_path)).collect()
    lines = c.execute(
        f"""SELECT count(DISTINCT (CAST(substr(p_brand, 7) AS INT), datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 120)), CAST(sum(l_quantity) AS BIGINT)
            FROM '{tmp_path}/lineitem.parquet' JOIN '{tmp_path}/part.parquet' ON l_partkey = p_partkey WHERE l_suppkey IS NULL"""
    ).fetchone()
    unnamed = [r for r in rows if r.store_id is None]
    assert (len(unnamed), sum(r.units_sold for r in unnamed)) == lines


def test_export_passes_over_the_fact_twice(spark, sf_small, tmp_path):
    """Once for everything merged (pair sums, order days, label counts, KPI grains), once for the cleaned rows."""
    from shelfwise.catalog import CATALOG, export_marts
    from shelfwise.sources.sinks import read_mart

    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        export_marts(p, str(tmp_path / "marts"))
        written = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in p._written]
        assert "pair_blocks" in written and not {"raw", "kpi_cube"} & set(written), written
    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        for name in ["product_map", "kpi_overall", "kpi_monthly", "kpi_category", "kpi_product", "kpi_store", "dash_monthly_units", "assessment_master"]:
            plain = [tuple(r) for r in CATALOG[name](p).collect()]
            assert sorted(map(tuple, read_mart(spark, str(tmp_path / "marts"), name).collect()), key=repr) == sorted(plain, key=repr), name
