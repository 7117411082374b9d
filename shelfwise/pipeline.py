"""Wiring of the analysis layers over one raw inventory table.

Stages that several steps read are written once under the cluster's
checkpoint folder (see :mod:`shelfwise.plans.materialize`); everything
else stays a lazy DataFrame so Catalyst can prune columns and push
filters through the whole chain.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from shelfwise.config import DEFAULT, Thresholds
from shelfwise.operators import assessment, cadence, impact, kpi, policy, quality, rollup, segments
from shelfwise.plans.global_order import DEFAULT_ROWS_PER_BUCKET, bucket_count
from shelfwise.plans.materialize import materialize, remove_written
from shelfwise.sources.inventory import RAW_COLUMNS, inventory_from_tpch, read_inventory


class InventoryPipeline:
    """The layered analysis over one daily store-product table.

    ``materialize_raw`` keeps the raw table for its second reader when
    the raw table is itself an expensive derivation (the TPC-H fixture):
    ``"cache"`` persists it (MEMORY_AND_DISK; lost blocks are recomputed
    from lineage), ``"write"`` writes it under the checkpoint folder, and
    ``"none"`` (the default, right for a Parquet/ORC/CSV source) reads the
    source again, pruned to the columns each step needs.
    ``materialize_stages`` also writes the pair-level stages, for runs
    that export many marts from one build.  Use the
    pipeline as a context manager, or call :meth:`close`, to remove the
    written stages.
    """

    def __init__(
        self,
        raw: DataFrame,
        thresholds: Thresholds = DEFAULT,
        negative_forecast: str = "zero",
        materialize_raw: str = "none",
        materialize_stages: bool = False,
        rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET,
    ) -> None:
        self.spark: SparkSession = raw.sparkSession
        self.source = raw
        self.t = thresholds
        self.negative_forecast = negative_forecast
        self.materialize_raw = materialize_raw
        self.materialize_stages = materialize_stages
        self.rows_per_bucket = rows_per_bucket
        self._written: list[str] = []

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self._written)

    def close(self) -> None:
        """Remove the stage tables this pipeline wrote.

        DataFrames built from this pipeline must not be used afterwards.
        """
        remove_written(self.spark, self._written)

    def __enter__(self) -> InventoryPipeline:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str, **kw) -> InventoryPipeline:
        kw.setdefault("materialize_raw", "write")
        return cls(inventory_from_tpch(spark, sf_dir), **kw)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, fmt: str = "parquet", **kw) -> InventoryPipeline:
        return cls(read_inventory(spark, path, fmt), **kw)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, name) if self.materialize_stages else df

    # ---- raw, maps, clean -------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        """The raw table for multi-pass use."""
        if self.materialize_raw == "write":
            return self._write(self.source, "raw")
        if self.materialize_raw == "cache":
            return self.source.persist(StorageLevel.MEMORY_AND_DISK)
        if self.materialize_raw == "none":
            return self.source
        raise ValueError(f"materialize_raw must be 'cache', 'write' or 'none', got {self.materialize_raw!r}")

    def _raw_single_pass(self) -> DataFrame:
        # a consumer whose reads of the raw table all happen in one job:
        # reuse the written copy if an earlier step made one, otherwise
        # read the source (a second derivation inside one job is cheaper
        # than a separate write job)
        return self.__dict__.get("raw", self.source)

    @cached_property
    def label_maps(self) -> DataFrame:
        """Canonical labels (entity, id, label): one scan, written, so joins know its size."""
        return self._write(quality.label_maps(self.pair_blocks if self._have("pair_blocks") else self._raw_single_pass()), "label_maps")

    @property
    def product_map(self) -> DataFrame:
        return quality.product_map(self.label_maps)

    @property
    def store_map(self) -> DataFrame:
        return quality.store_map(self.label_maps)

    @cached_property
    def clean(self) -> DataFrame:
        # an export reads the cleaned rows once, and its maps come from the blocks: no copy of the raw table
        raw = self._raw_single_pass() if self.materialize_stages and self._have("pair_blocks") else self.raw
        return quality.inventory_clean(raw, self.product_map, self.store_map, self.negative_forecast)

    def clean_unlabelled(self) -> DataFrame:
        """Cleaned rows without the label lookups.

        The lookups are left joins on unique keys, so they never change
        the row set: store-, month- and whole-table rollups skip them.
        """
        raw = self._raw_single_pass()
        return raw.selectExpr(*RAW_COLUMNS, f"{quality.clean_forecast(self.negative_forecast)} AS demand_forecast_clean")

    def kpi_base(self, labels: bool = True) -> DataFrame:
        src = self.clean if labels else self.clean_unlabelled()
        return kpi.kpi_base(src, self.t.low_cover_days, self.t.high_cover_days)

    @cached_property
    def kpi_grains(self) -> DataFrame:
        """Every KPI grain, merged from one written pre-aggregate: for builds that make many KPI tables."""
        if self._have("pair_blocks") and "month" in self.pair_blocks.columns:
            cube = rollup.kpi_cube_of(self.pair_blocks)
        else:
            cube = self._write(kpi.kpi_cube(self.kpi_base(labels=False)), "kpi_cube")
        return self._write(kpi.kpi_grains(cube), "kpi_grains")

    def kpi_rows(self, grain: str) -> DataFrame:
        """What a KPI table of this grain merges: its partial sums where they are written, else the KPI base."""
        return self.kpi_grains.where(f"grain = '{grain}'") if self._have("kpi_grains") else self.kpi_base(labels=False)

    @cached_property
    def duplicate_keys(self) -> DataFrame:
        crowded = self._write(quality.crowded_blocks(self.raw), "crowded_blocks")
        return self._write(quality.duplicate_keys(self.raw, crowded), "duplicate_keys")

    def quality_flags(self) -> DataFrame:
        return quality.quality_flags(self.clean, self.duplicate_keys)

    @cached_property
    def audit_pairs(self) -> DataFrame:
        return self._write(quality.audit_pairs(self._raw_single_pass()), "audit_pairs")

    # ---- pair level ---------------------------------------------------------
    @cached_property
    def pair_sums(self) -> DataFrame:
        return self._write(rollup.pair_sums(self.kpi_base(labels=False)), "pair_sums")

    @cached_property
    def pair_blocks(self) -> DataFrame:
        """The one pass over the fact that rollup and cadence share; in an export the KPI grains, too."""
        return self._write(rollup.pair_blocks(self.kpi_base(labels=False), monthly=self.materialize_stages), "pair_blocks")

    def _have(self, name: str) -> bool:
        return name in self.__dict__

    @cached_property
    def rollup(self) -> DataFrame:
        # the rollup alone needs no blocks; where they are there anyway, they are its sums
        sums = self.pair_blocks if self._have("pair_blocks") else self.pair_sums
        return self._write(rollup.pair_rollup(sums), "pair_rollup")

    @cached_property
    def pair_count(self) -> int:
        return self.rollup.count()

    @cached_property
    def segments(self) -> DataFrame:
        buckets = bucket_count(self.pair_count, self.rows_per_bucket)
        seg = segments.inventory_segments(self.rollup, buckets, self.t, registry=self._written)
        return self._stage(seg, "segments")

    @cached_property
    def cadence(self) -> DataFrame:
        blocks = rollup.order_blocks_of(self.pair_blocks) if self._have("pair_blocks") else cadence.order_blocks(self.kpi_base(labels=False))
        return self._stage(cadence.order_cadence(blocks), "cadence")

    @cached_property
    def order_rows(self) -> DataFrame:
        return self._write(cadence.order_rows(self.kpi_base(labels=False)), "order_rows")

    @cached_property
    def positions(self) -> DataFrame:
        return segments.positions(self.rollup, self.t)

    @cached_property
    def policy(self) -> DataFrame:
        return policy.policy_diagnosis(self.segments, self.t)

    @cached_property
    def policy_labels(self) -> DataFrame:
        """The diagnosis without segment labels: for everything that does not show them, no ordering runs."""
        return policy.policy_diagnosis(self.rollup, self.t)

    @cached_property
    def assessment(self) -> DataFrame:
        _ = self.pair_blocks if not (self._have("rollup") and self._have("cadence")) else None
        rb = self.rollup
        return self._stage(assessment.reorder_assessment(rb, self.cadence, self.t), "assessment")

    @cached_property
    def impact(self) -> DataFrame:
        # the impact view uses the policy labels but no segment label, so
        # it is built on the rollup and never waits for the orderings
        _ = self.pair_blocks if not (self._have("rollup") and self._have("cadence")) else None
        rb = self.rollup
        return self._stage(impact.business_impact(rb, self.cadence, self.t), "impact")
