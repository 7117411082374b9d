"""Spark results against the DuckDB oracle on the smallest fixture, and plan shape."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from shelfwise.catalog import CATALOG
from shelfwise.operators import quality
from shelfwise.pipeline import InventoryPipeline

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
SAMPLE = [
    "audit_summary", "clean_label_conflicts", "order_events", "kpi_monthly", "kpi_product", "quality_flags", "inventory_segments",
    "diagnosis_master", "order_cadence", "reorder_assessment", "impact_overall", "dash_impact_by_region",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(E.queries()) and set(CATALOG) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf_small, con, name):
    df = E.queries()[name](spark, sf_small)
    cols = df.columns
    got = Counter(tuple(_norm(v) for v in r) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert sorted(cols) == sorted(rel.columns)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "impact_theme" in df.columns


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_never_use_a_single_partition(spark, sf_small):
    p = InventoryPipeline.from_tpch(spark, sf_small, rows_per_bucket=40)
    seg = p.segments
    seg.collect()
    plan = _plan(seg)
    assert "SinglePartition" not in plan
    assert "RangePartitioning" not in plan  # bucket ids were frozen by the write


def test_label_lookups_are_broadcast(spark, sf_small):
    p = InventoryPipeline.from_tpch(spark, sf_small)
    plan = p.clean._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _relations(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


@pytest.mark.parametrize("name", ["impact_overall", "reorder_assessment"])
def test_impact_and_assessment_read_the_fact_once(spark, sf_small, name):
    """One pass for pair sums, label counts and order days."""
    raw = InventoryPipeline.from_tpch(spark, sf_small).raw
    p = InventoryPipeline(raw)
    scans = []
    real = p._write

    def write(df, name):
        scans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("weather_condition") or _relations(df)))
        return real(df, name)

    p._write = write
    bi = CATALOG[name](p)
    assert bi.collect()
    written = dict(scans)
    assert written["pair_blocks"] == 1  # the fact, once
    # the rollup reads the blocks table (rows and labels), the query the rollup and the blocks
    assert set(written) == {"pair_blocks", "pair_rollup"}
    assert _relations(bi) == 2
    assert "weather_condition" not in bi._jdf.queryExecution().optimizedPlan().toString()


def test_order_events_move_order_rows_once(spark, sf_small):
    with InventoryPipeline(InventoryPipeline.from_tpch(spark, sf_small).raw) as p:
        assert _relations(p.kpi_base(labels=False)) == 1
        events = CATALOG["order_events"](p)
        # the written order rows twice: as they are, and combined to blocks before they move
        assert _relations(events) == 2
        before = events._jdf.queryExecution().sparkPlan().toString()
        assert before.count("Window [row_number") == 1 and "CartesianProduct" not in before
        events.collect()
        ran = _plan(events)
        final = ran[: ran.find("Initial Plan")]
        rows_moved = [x for x in final.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
        assert len(rows_moved) <= 4, rows_moved  # blocks (twice), their join side, order rows


def test_duplicates_shuffle_blocks_not_keys(spark, sf_small):
    raw = InventoryPipeline.from_tpch(spark, sf_small).raw
    with InventoryPipeline(raw) as p:
        plan = _plan(quality.audit_pairs(raw))
        exchanges = [x for x in plan.splitlines() if "Exchange" in x]
        assert all("date" not in x.split("ENSURE")[0] for x in exchanges) and "bit_or" in plan
        CATALOG["audit_summary"](p).collect()
        assert not any("duplicate" in w or "crowded" in w for w in p._written)


def test_summaries_without_segment_labels_run_no_ordering(spark, sf_small):
    names = ["position_distribution", "position_summary", "policy_row_count", "policy_status_distribution", "root_cause_distribution",
             "priority_distribution", "policy_status_summary", "root_cause_summary", "category_policy_summary", "region_policy_summary"]
    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        for name in names:
            assert CATALOG[name](p).collect()
        assert not any("buckets" in path for path in p._written)


def test_label_kpis_scan_once(spark, sf_small):
    p = InventoryPipeline(InventoryPipeline.from_tpch(spark, sf_small).raw)
    for name in ["kpi_category", "kpi_region", "kpi_product", "map_conflicts"]:
        assert _relations(CATALOG[name](p)) == 1, name


def test_store_rollup_skips_label_joins(spark, sf_small):
    plan = _plan(E.queries()["kpi_store"](spark, sf_small))
    assert "LeftOuter" not in plan


def test_cadence_window_runs_on_block_aggregates(spark, sf_small):
    """The LAG window must see one row per (pair, 64 days), never raw order rows."""
    p = InventoryPipeline.from_tpch(spark, sf_small)
    lines = p.cadence._jdf.queryExecution().optimizedPlan().toString().splitlines()
    win = next(i for i, line in enumerate(lines) if "Window [lag(" in line)
    below = "\n".join(lines[win + 1:])
    agg, rel = below.find("Aggregate [store_id"), below.find("Relation")
    assert agg != -1 and (rel == -1 or agg < rel) and "bit_or" in below
