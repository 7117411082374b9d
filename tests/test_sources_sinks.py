"""File sources (parquet, CSV with the original header spelling) and the mart export."""

from __future__ import annotations

import tempfile

import duckdb
import pytest

from shelfwise.catalog import CATALOG, EXPORT_MARTS, export_marts, register_views
from shelfwise.oracle import oracle_sql
from shelfwise.pipeline import InventoryPipeline
from shelfwise.sources.inventory import RAW_COLUMNS, RAW_SCHEMA, inventory_from_tpch, quarantine
from shelfwise.sources.sinks import Check, ExportError, manifest, publish_marts, read_mart

HEADER = [
    "Date", "Store_ID", "Product_ID", "Category", "Region", "Inventory_Level", "Units_Sold", "Units_Ordered",
    "Demand_Forecast", "Price", "Discount", "Weather_Condition", "Holiday_Promotion", "Competitor_Pricing",
    "Seasonality",
]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parquet_and_csv_sources_agree(spark, sf_small):
    raw = inventory_from_tpch(spark, sf_small)
    out = tempfile.mkdtemp(prefix="sw-src-")
    raw.write.parquet(f"{out}/pq")
    raw.toDF(*HEADER).write.option("header", "true").csv(f"{out}/csv")
    from_pq = InventoryPipeline.from_path(spark, f"{out}/pq")
    from_csv = InventoryPipeline.from_path(spark, f"{out}/csv", fmt="csv")
    assert from_csv.source.select(*RAW_COLUMNS).schema == RAW_SCHEMA
    assert from_csv.source.agg({"rejected_cells": "max"}).first()[0] == 0
    for q in ["kpi_overall", "kpi_category", "impact_overall"]:
        assert _rows(CATALOG[q](from_pq)) == _rows(CATALOG[q](from_csv))
    derived = InventoryPipeline.from_tpch(spark, sf_small)
    assert _rows(CATALOG["impact_overall"](from_pq)) == _rows(CATALOG["impact_overall"](derived))


def test_export_marts(spark, sf_small):
    p = InventoryPipeline.from_tpch(spark, sf_small)
    out = tempfile.mkdtemp(prefix="sw-marts-")
    paths = export_marts(p, out)
    assert set(paths) == set(EXPORT_MARTS)
    # every written table equals its SQL
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    sqls = oracle_sql()
    for name, path in paths.items():
        back = spark.read.parquet(path)
        rel = con.execute(sqls[name])
        cols = [d[0] for d in rel.description]
        assert sorted(back.columns) == sorted(cols), name
        show = lambda r: tuple(str(x) for x in r)
        assert sorted(map(show, back.select(*cols).collect())) == sorted(map(show, rel.fetchall())), name
    csv = export_marts(p, out + "-csv", fmt="csv")
    head = spark.read.option("header", "true").csv(csv["dash_headline"]).columns
    assert "excess_sales_share_pct" in head


def test_pipeline_removes_its_stage_tables(spark, sf_small):
    import os

    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        assert CATALOG["impact_overall"](p).collect()
        assert CATALOG["abc_summary"](p).collect()
        written = list(p._written)
        assert len(written) >= 3  # raw, pair rollup, ordering buckets
        local = [w.replace("file:", "") for w in written]
        assert all(os.path.exists(w) for w in local)
    assert p._written == []
    assert not any(os.path.exists(w) for w in local)


def test_csv_cells_that_do_not_fit_are_counted(spark):
    out = tempfile.mkdtemp(prefix="sw-bad-")
    lines = [",".join(HEADER)]
    good = "2023-01-0{d},S1,P1,Cat,East,{inv},5,{o},{fc},1.5,0.1,Sunny,0,1.0,Winter"
    lines += [good.format(d=1, inv=10, o=0, fc="135.47"), good.format(d=2, inv="10.5", o="3.0", fc="-0.25"), good.format(d=3, inv="many", o=2, fc="")]
    with open(f"{out}/rows.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    p = InventoryPipeline.from_path(spark, out, fmt="csv")
    got = {r["date"].day: r for r in CATALOG["inventory_raw"](p).collect()}
    assert got[1].demand_forecast == 135.47 and got[2].demand_forecast == -0.25 and got[3].demand_forecast is None
    assert (got[2].units_ordered, got[2].inventory_level, got[3].inventory_level) == (3, None, None)
    (audit,) = CATALOG["audit_summary"](p).collect()
    assert (audit.total_rows, audit.rejected_cells, audit.missing_values, audit.negative_forecast_rows) == (3, 2, 3, 1)


def test_malformed_lines_are_counted_and_kept_apart(spark, tmp_path):
    good = "2023-01-0{d},S1,P1,Cat,East,{inv},5,0,1.5,1.5,0.1,Sunny,0,1.0,Winter"
    surplus, short, quoted = good.format(d=2, inv=7) + ",extra,cells", "2023-01-03,S1,P1,Cat", good.format(d=5, inv=3).replace("Cat", '"Cat, too"')
    lines = [",".join(HEADER), good.format(d=1, inv=10), surplus, short, good.format(d=4, inv="many"), quoted]
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    p = InventoryPipeline.from_path(spark, str(tmp_path), fmt="csv")
    got = {r["date"].day: r for r in CATALOG["inventory_raw"](p).collect()}
    assert got[2].inventory_level == 7 and got[3].category == "Cat" and got[3].region is None and got[5].category == "Cat, too"
    (audit,) = CATALOG["audit_summary"](p).collect()
    assert (audit.total_rows, audit.rejected_cells) == (5, 3)
    # a query of one column sees the same lines
    assert p.source.agg({"rejected_cells": "sum"}).first()[0] == 3
    rejected = quarantine(spark, str(tmp_path), fmt="csv").collect()
    assert all(r.file.endswith("rows.csv") for r in rejected)
    assert sorted((r.column or "", r.cell) for r in rejected) == sorted([("", surplus), ("", short), ("inventory_level", "many")])


def test_quarantine_of_typed_sources(spark, tmp_path):
    rows = spark.createDataFrame([("2023-01-01", "S1", "x7", 4)], "date string, store_id string, inventory_level string, units_sold int")
    rest = [c for c in RAW_COLUMNS if c not in rows.columns]
    rows.selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in rest]).write.parquet(str(tmp_path / "pq"))
    assert [(r.column, r.cell) for r in quarantine(spark, str(tmp_path / "pq")).collect()] == [("inventory_level", "x7")]


def test_a_failed_export_leaves_the_last_one(spark, tmp_path):
    out = str(tmp_path / "marts")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "label string")
    publish_marts({"a": table("x", "y"), "b": table("z")}, out, checks={"a": Check(rows=2, labels=("label",))})
    first = manifest(spark, out)
    assert first["rows"] == {"a": 2, "b": 1} and read_mart(spark, out, "a").count() == 2
    for bad, reason in ((table("x", None), "NULL"), (table("x"), "1 rows")):
        with pytest.raises(ExportError, match=reason):
            publish_marts({"a": bad, "b": table("new")}, out, checks={"a": Check(rows=2, labels=("label",))})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        publish_marts({"a": table("x", "y"), "b": spark.sql("SELECT 1 / CAST(id AS INT) AS label FROM range(3)")}, out)
    assert manifest(spark, out) == first and [r.label for r in read_mart(spark, out, "b").collect()] == ["z"]
    assert sorted(x.name for x in (tmp_path / "marts").iterdir() if not x.name.startswith(".")) == ["_manifest.json", first["version"]]
    second = publish_marts({"b": table("q")}, out)
    publish_marts({"b": table("r")}, out, fmt="csv")
    # the version before stays for its readers, older ones go
    assert spark.read.parquet(second["b"]).count() == 1 and [r.label for r in read_mart(spark, out, "b").collect()] == ["r"]
    assert not (tmp_path / "marts" / first["version"]).exists()
    with pytest.raises(KeyError):
        read_mart(spark, out, "a")


def test_export_stops_at_a_pair_with_two_labels(spark, sf_small, tmp_path):
    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        _ = p.pair_blocks
        first = p.rollup.orderBy("store_id", "product_id").limit(1).selectExpr("* EXCEPT (region_clean)", "'elsewhere' AS region_clean")
        p.__dict__["rollup"] = p._write(p.rollup.unionByName(first), "broken_rollup")
        with pytest.raises(ExportError, match="store-product pairs"):
            export_marts(p, str(tmp_path / "marts"))
        assert manifest(spark, str(tmp_path / "marts")) == {}


def test_views_by_name(spark, sf_small):
    with InventoryPipeline.from_tpch(spark, sf_small) as p:
        names = register_views(p, "sw_")
        assert "sw_business_impact" in names
        n = spark.sql("SELECT count(*) FROM sw_business_impact JOIN sw_inventory_segments USING (store_id, product_id)").first()[0]
        assert n == 250
        for v in names:
            spark.catalog.dropTempView(v)
