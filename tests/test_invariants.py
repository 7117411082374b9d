
from __future__ import annotations

import pytest

from shelfwise.catalog import CATALOG
from shelfwise.pipeline import InventoryPipeline


@pytest.fixture(scope="module")
def built(spark, sf_small):
    return InventoryPipeline.from_tpch(spark, sf_small, materialize_stages=True)


def q(p, name):
    return CATALOG[name](p).collect()


def test_row_counts_agree_across_layers(built):
    n = q(built, "sku_store_count")[0][0]
    assert n == len(q(built, "inventory_segments"))
    assert n == q(built, "policy_row_count")[0][0]
    assert n == q(built, "assessment_row_count")[0][0]
    assert n == q(built, "impact_row_count")[0][0]
    assert sum(r.sku_store_count for r in q(built, "impact_theme_distribution")) == n
    assert sum(r.sku_store_count for r in q(built, "reorder_distribution")) == n


def test_kpi_grains_add_up(built):
    (overall,) = q(built, "kpi_overall")
    for grain in ["kpi_monthly", "kpi_category", "kpi_region", "kpi_store", "kpi_product"]:
        rows = q(built, grain)
        for m in ["total_units_sold", "total_units_ordered", "total_at_risk_units_proxy", "total_excess_units_proxy"]:
            assert sum(r[m] for r in rows) == overall[m], (grain, m)
    assert q(built, "check_total_units_sold")[0][0] == overall.total_units_sold
    assert q(built, "check_total_units_ordered")[0][0] == overall.total_units_ordered
    assert sum(r.total_units_sold for r in q(built, "sku_store_summary")) == overall.total_units_sold


def test_segments_shares_and_tiles(built):
    seg = q(built, "inventory_segments")
    assert max(r.cumulative_units_share for r in seg) == pytest.approx(1.0)
    assert sum(r.units_sales_share for r in seg) == pytest.approx(1.0)
    for tile in ["velocity_tile", "forecast_tile"]:
        sizes = [sum(1 for r in seg if r[tile] == t) for t in (1, 2, 3)]
        assert max(sizes) - min(sizes) <= 1


def test_null_label_checks_are_empty(built):
    for name in ["segment_null_labels", "policy_null_labels", "assessment_null_labels", "impact_null_labels",
                 "kpi_bad_numeric_rows"]:
        assert q(built, name) == [], name


def test_pair_labels_are_functional(built):
    pairs = [(r.store_id, r.product_id) for r in q(built, "sku_store_summary")]
    assert len(pairs) == len(set(pairs))
    pm = {r.product_id: r.category_clean for r in q(built, "product_map")}
    sm = {r.store_id: r.region_clean for r in q(built, "store_map")}
    for r in q(built, "sku_store_summary"):
        assert r.category_clean == pm[r.product_id] and r.region_clean == sm[r.store_id]


def test_dashboard_matches_impact_totals(built):
    (head,) = q(built, "dash_headline")
    (imp,) = q(built, "impact_overall")
    assert head.total_units_sold == imp.total_units_sold
    assert head.high_priority_items == imp.high_priority_item_count
    assert head.operational_burden_items == imp.operational_burden_item_count
    assert head.excess_sales_share_pct == imp.sales_share_in_excess_items_pct
    assert sum(r.primary_impact_units for r in q(built, "dash_impact_by_region")) == head.primary_impact_units
    assert sum(r.impact_share_pct for r in q(built, "dash_impact_by_category")) == pytest.approx(100.0, abs=0.05)
