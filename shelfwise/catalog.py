"""Registry of every query: name -> builder over an :class:`InventoryPipeline`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfwise.functions import presented
from shelfwise.operators import assessment as E
from shelfwise.operators import cadence as E12
from shelfwise.operators import dashboard as G
from shelfwise.operators import impact as Fi
from shelfwise.operators import kpi as B
from shelfwise.operators import policy as D
from shelfwise.operators import quality as A
from shelfwise.operators import rollup as C1
from shelfwise.operators import segments as C
from shelfwise.pipeline import InventoryPipeline
from shelfwise.sources.inventory import RAW_COLUMNS

Builder = Callable[[InventoryPipeline], DataFrame]


def _by_label(p: InventoryPipeline, entity: str, label: str, keep_id: bool = False) -> DataFrame:
    return B.kpi_by_label(p.kpi_rows(entity), entity, label, keep_id)


_BUILDERS: dict[str, Builder] = {
    # A: sources, audit, cleaning
    "inventory_raw": lambda p: p.source.select(*RAW_COLUMNS),
    "audit_summary": lambda p: A.audit_summary(p.audit_pairs),
    "product_map": lambda p: p.product_map,
    "store_map": lambda p: p.store_map,
    "inventory_clean": lambda p: p.clean,
    "quality_flags": lambda p: p.quality_flags(),
    "negative_forecast_rows": lambda p: A.negative_forecast_rows(p.clean),
    "map_conflicts": lambda p: A.map_conflicts(p.source),
    "clean_label_conflicts": lambda p: A.clean_label_conflicts(p.clean),
    # B: KPI layer
    "kpi_null_check": lambda p: A.kpi_null_check(p.clean_unlabelled(), p.label_maps),
    "kpi_bad_numeric_rows": lambda p: A.kpi_bad_numeric_rows(p.clean),
    "kpi_base": lambda p: p.kpi_base(),
    "kpi_base_preview": lambda p: B.kpi_base_preview(p.kpi_base(labels=False), p.label_maps),
    "kpi_overall": lambda p: B.kpi_overall(p.kpi_rows("all")),
    "kpi_monthly": lambda p: B.kpi_monthly(p.kpi_rows("month")),
    "kpi_category": lambda p: _by_label(p, "product", "category_clean"),
    "kpi_region": lambda p: _by_label(p, "store", "region_clean"),
    "kpi_store": lambda p: B.kpi_store(p.kpi_rows("store")),
    "kpi_product": lambda p: _by_label(p, "product", "category_clean", keep_id=True),
    "check_total_units_sold": lambda p: B.check_total_units_sold(p.clean_unlabelled()),
    "check_total_units_ordered": lambda p: B.check_total_units_ordered(p.clean_unlabelled()),
    "check_flag_totals": lambda p: B.check_flag_totals(p.kpi_base(labels=False)),
    "lowest_cover_rows": lambda p: B.lowest_cover_rows(p.kpi_base(labels=False), p.label_maps),
    "highest_cover_rows": lambda p: B.highest_cover_rows(p.kpi_base(labels=False), p.label_maps),
    "forecast_error_stats": lambda p: B.forecast_error_stats(p.kpi_base(labels=False)),
    "check_wape_bias": lambda p: B.check_wape_bias(p.kpi_base(labels=False)),
    # C: segmentation
    "sku_store_summary": lambda p: C1.sku_store_summary(p.rollup, exact_digits=10),
    "sku_store_count": lambda p: C1.sku_store_count(p.rollup),
    "sku_store_top20": lambda p: C1.sku_store_top20(p.rollup),
    "inventory_segments": lambda p: C.segments_view(p.segments),
    "segments_preview": lambda p: C.segments_preview(p.segments),
    "abc_distribution": lambda p: C.abc_distribution(p.segments),
    "velocity_distribution": lambda p: C.velocity_distribution(p.segments),
    "forecast_distribution": lambda p: C.forecast_distribution(p.segments),
    "position_distribution": lambda p: C.position_distribution(p.positions),
    "segment_null_labels": lambda p: C.segment_null_labels(p.segments),
    "segment_master": lambda p: C.segment_master(p.segments),
    "abc_summary": lambda p: C.abc_summary(p.segments),
    "velocity_summary": lambda p: C.velocity_summary(p.segments),
    "forecast_summary": lambda p: C.forecast_summary(p.segments),
    "position_summary": lambda p: C.position_summary(p.positions),
    # D: policy diagnosis
    "order_metrics": lambda p: C1.order_metrics(p.rollup),
    "policy_diagnosis": lambda p: p.policy,
    "policy_row_count": lambda p: D.policy_row_count(p.policy_labels),
    "policy_top20": lambda p: D.policy_top20(p.policy),
    "policy_status_distribution": lambda p: D.policy_status_distribution(p.policy_labels),
    "root_cause_distribution": lambda p: D.root_cause_distribution(p.policy_labels),
    "priority_distribution": lambda p: D.priority_distribution(p.policy_labels),
    "policy_null_labels": lambda p: D.policy_null_labels(p.policy),
    "diagnosis_master": lambda p: D.diagnosis_master(p.policy),
    "policy_status_summary": lambda p: D.policy_status_summary(p.policy_labels),
    "root_cause_summary": lambda p: D.root_cause_summary(p.policy_labels),
    "category_policy_summary": lambda p: D.category_policy_summary(p.policy_labels),
    "region_policy_summary": lambda p: D.region_policy_summary(p.policy_labels),
    "high_priority_items": lambda p: D.high_priority_items(p.policy),
    # E: cadence and assessment
    "order_events": lambda p: E12.order_events(p.order_rows),
    "order_cadence": lambda p: p.cadence,
    "replenishment_base": lambda p: C1.replenishment_base(p.rollup),
    "reorder_assessment": lambda p: p.assessment,
    "assessment_row_count": lambda p: E.assessment_row_count(p.assessment),
    "assessment_top20": lambda p: E.assessment_top20(p.assessment),
    "reorder_distribution": lambda p: E.reorder_distribution(p.assessment),
    "safety_stock_distribution": lambda p: E.safety_stock_distribution(p.assessment),
    "lead_time_distribution": lambda p: E.lead_time_distribution(p.assessment),
    "variability_distribution": lambda p: E.variability_distribution(p.assessment),
    "assessment_null_labels": lambda p: E.assessment_null_labels(p.assessment),
    "assessment_master": lambda p: E.assessment_master(p.assessment),
    "reorder_summary": lambda p: E.reorder_summary(p.assessment),
    "safety_stock_summary": lambda p: E.safety_stock_summary(p.assessment),
    "lead_time_summary": lambda p: E.lead_time_summary(p.assessment),
    "category_assessment_summary": lambda p: E.category_assessment_summary(p.assessment),
    "review_priority_items": lambda p: E.review_priority_items(p.assessment),
    # F: business impact
    "business_impact": lambda p: p.impact,
    "impact_row_count": lambda p: Fi.impact_row_count(p.impact),
    "impact_top20": lambda p: Fi.impact_top20(p.impact),
    "impact_theme_distribution": lambda p: Fi.impact_theme_distribution(p.impact),
    "impact_priority_distribution": lambda p: Fi.impact_priority_distribution(p.impact),
    "impact_null_labels": lambda p: Fi.impact_null_labels(p.impact),
    "impact_master": lambda p: Fi.impact_master(p.impact),
    "impact_overall": lambda p: Fi.impact_overall(p.impact),
    "impact_theme_summary": lambda p: Fi.impact_theme_summary(p.impact),
    "category_impact_summary": lambda p: Fi.category_impact_summary(p.impact),
    "region_impact_summary": lambda p: Fi.region_impact_summary(p.impact),
    "top_impact_items": lambda p: Fi.top_impact_items(p.impact),
    # G: dashboard marts
    "dash_headline": lambda p: G.dash_headline(p.impact),
    "dash_monthly_units": lambda p: G.dash_monthly_units(p.kpi_rows("month")),
    "dash_monthly_wape": lambda p: G.dash_monthly_wape(p.kpi_rows("month")),
    "dash_priority_by_region": lambda p: G.dash_priority_by_region(p.impact),
    "dash_impact_by_region": lambda p: G.dash_impact_by_region(p.impact),
    "dash_impact_by_category": lambda p: G.dash_impact_by_category(p.impact),
    # a sum of sales needs the KPI rows by category only; written, as the share reads them twice
    "dash_sales_by_category": lambda p: G.dash_sales_by_category(p._write(_by_label(p, "product", "category_clean"), "category_kpis")),
    "dash_trigger_counts": lambda p: G.dash_trigger_counts(p.assessment),
    "export_marts": lambda p: export_report(p),
}

# exact decimals inside, doubles in what a query shows
CATALOG: dict[str, Builder] = {name: (lambda p, f=f: presented(f(p))) for name, f in _BUILDERS.items()}

# Tables written by the export step (G9), as published: the cleaned model
# tables and KPI summaries, segment, diagnosis, assessment and impact exports
# plus their summaries, and the dashboard data.
EXPORT_MARTS = [
    "product_map", "store_map", "inventory_clean",
    "kpi_overall", "kpi_monthly", "kpi_category", "kpi_region", "kpi_store", "kpi_product",
    "segment_master", "abc_summary", "velocity_summary", "forecast_summary", "position_summary",
    "diagnosis_master", "policy_status_summary", "root_cause_summary",
    "category_policy_summary", "region_policy_summary", "high_priority_items",
    "assessment_master", "reorder_summary", "safety_stock_summary", "lead_time_summary",
    "category_assessment_summary", "review_priority_items",
    "impact_master", "impact_overall", "impact_theme_summary", "category_impact_summary",
    "region_impact_summary", "top_impact_items",
    "dash_headline", "dash_monthly_units", "dash_monthly_wape", "dash_priority_by_region",
    "dash_impact_by_region", "dash_impact_by_category", "dash_sales_by_category", "dash_trigger_counts",
]


def build(name: str, pipeline: InventoryPipeline) -> DataFrame:
    return CATALOG[name](pipeline)


# the layered views by name: what a user of the analysis queries with SQL
VIEWS = {
    "inventory_clean": "inventory_clean",
    "kpi_base": "kpi_base",
    "sku_store_summary": "sku_store_summary",
    "inventory_segments": "inventory_segments",
    "policy_diagnosis": "policy_diagnosis",
    "order_cadence": "order_cadence",
    "replenishment_base": "replenishment_base",
    "reorder_assessment": "reorder_assessment",
    "business_impact": "business_impact",
}


def register_views(pipeline: InventoryPipeline, prefix: str = "") -> list[str]:
    """Register the layered views as temporary views of the pipeline's session; returns their names."""
    for view, name in VIEWS.items():
        CATALOG[name](pipeline).createOrReplaceTempView(f"{prefix}{view}")
    return [f"{prefix}{view}" for view in VIEWS]


def export_report(pipeline: InventoryPipeline) -> DataFrame:
    """G9 as a query: exports every table beside the pipeline's stages and lists what was published (mart, row_count)."""
    from shelfwise.plans.materialize import checkpoint_root
    from shelfwise.sources.sinks import manifest

    spark = pipeline.spark
    out = f"{checkpoint_root(spark).rstrip('/')}/shelfwise/marts-{uuid.uuid4().hex}"
    pipeline._written.append(out)
    export_marts(pipeline, out)
    return spark.createDataFrame(sorted(manifest(spark, out)["rows"].items()), "mart string, row_count long")


# pair-level exports: a row per pair, every label set
MASTERS = {
    "segment_master": tuple(C.SEGMENT_LABELS),
    "diagnosis_master": tuple(D.POLICY_LABELS),
    "assessment_master": tuple(E.ASSESSMENT_LABELS),
    "impact_master": ("impact_theme", "impact_priority"),
}


def export_marts(pipeline: InventoryPipeline, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every export table from one build of the pipeline, and publish them together.

    Many tables read the pair-level stages, so these are written once,
    whatever the pipeline was set to.  The analysis' row-count and null-label
    checks, and that no pair carries two labels (it would be two rows), are
    counted by the writing jobs; if one fails, nothing is published.
    """
    from shelfwise.sources.sinks import Check, publish_marts

    pipeline.materialize_stages = True
    _ = pipeline.pair_blocks, pipeline.kpi_grains  # one pass over the fact for rollup, cadence, label maps and all KPI tables
    pairs = pipeline.rollup.select("store_id", "product_id").distinct().count()
    checks = {name: Check(rows=pairs, labels=labels) for name, labels in MASTERS.items()}
    return publish_marts({n: build(n, pipeline) for n in EXPORT_MARTS}, out_dir, fmt=fmt, checks=checks)
