"""Hand-written edge rows (FIXTURES.md section 3) the driver fixture never reaches."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import random
import statistics

import pytest

from shelfwise import config as L
from shelfwise.catalog import CATALOG
from shelfwise.config import Thresholds
from shelfwise.pipeline import InventoryPipeline
from shelfwise.sources.inventory import RAW_COLUMNS, RAW_SCHEMA

D0 = dt.date(2023, 1, 1)


def row(day=0, store="S1", product="P1", inv=10, sold=5, ordered=0, fc=5, **kw):
    base = dict(
        date=D0 + dt.timedelta(days=day), store_id=store, product_id=product, category="Cat", region="East",
        inventory_level=inv, units_sold=sold, units_ordered=ordered, demand_forecast=decimal.Decimal(str(fc)), price=1.0,
        discount=0.1, weather_condition="Sunny", holiday_promotion=0, competitor_pricing=1.0, seasonality="Winter",
    )
    base.update(kw)
    return tuple(base[c] for c in RAW_COLUMNS)


def pipeline(spark, rows, **kw):
    return InventoryPipeline(spark.createDataFrame(rows, RAW_SCHEMA), **kw)


def one(df):
    rows = df.collect()
    return {(r["store_id"], r["product_id"]): r for r in rows}


def test_row_level_cover_and_proxies(spark):
    p = pipeline(spark, [
        row(0, inv=50, fc=0),              # zero forecast
        row(1, inv=10, fc=-3),             # negative forecast -> clipped to 0
        row(2, inv=4, fc=4),               # cover exactly 1
        row(3, inv=28, fc=4),              # cover exactly 7
        row(4, inv=0, fc=4),               # zero inventory
    ])
    kb = {r["date"]: r for r in CATALOG["kpi_base"](p).collect()}
    r0, r1, r2, r3, r4 = (kb[D0 + dt.timedelta(days=i)] for i in range(5))
    assert r0.cover_days is None and r0.low_cover_flag == 0 and r0.high_cover_flag == 0
    assert r0.excess_units_proxy == 50 and r0.at_risk_units_proxy == 0
    assert r1.demand_forecast_clean == 0 and r1.cover_days is None
    assert (r2.cover_days, r2.low_cover_flag, r2.high_cover_flag) == (1.0, 0, 0)
    assert (r3.cover_days, r3.low_cover_flag, r3.high_cover_flag) == (7.0, 0, 0)
    assert (r4.zero_inventory_flag, r4.low_cover_flag, r4.at_risk_units_proxy) == (1, 1, 4)
    neg = CATALOG["negative_forecast_rows"](p).collect()
    assert [r.demand_forecast for r in neg] == [-3]
    flags = {r["date"]: r for r in CATALOG["quality_flags"](p).collect()}
    assert flags[D0 + dt.timedelta(days=1)].Negative_Forecast_Flag == 1


def test_half_up_rounding(spark):
    p = pipeline(spark, [row(0, sold=40, ordered=23)])
    (k,) = CATALOG["kpi_overall"](p).collect()
    assert k.replenishment_to_sales_ratio == 0.58


def test_pair_edge_cases(spark):
    rows = []
    rows += [row(d, "S1", "P1", sold=0, ordered=0) for d in range(5)]          # zero sales, no orders
    rows += [row(0, "S2", "P1", sold=3, ordered=0)]                            # single row
    rows += [row(0, "S3", "P1", sold=3, ordered=7)]                            # one order on the only day
    rows += [row(d, "S4", "P1", inv=2, fc=4, sold=4) for d in range(5)]        # cover .5 ...
    rows += [row(d, "S4", "P1", inv=36, fc=4, sold=4) for d in range(5, 10)]   # ... and cover 9
    p = pipeline(spark, rows)
    bi = one(CATALOG["business_impact"](p))
    ra = one(CATALOG["reorder_assessment"](p))
    seg = one(CATALOG["inventory_segments"](p))

    z = ra[("S1", "P1")]
    assert z.wape is None and z.demand_cv is None and z.order_event_count is None
    assert z.demand_variability_band == L.VARIABILITY_LOW
    assert z.lead_time_behavior_proxy == L.CADENCE_MODERATE
    assert bi[("S1", "P1")].primary_impact_vs_sales_ratio is None
    assert seg[("S1", "P1")].forecast_tile == 3  # NULL wape sorts last

    s = ra[("S2", "P1")]
    assert s.demand_stddev is None and s.demand_cv is None

    o = ra[("S3", "P1")]
    assert o.order_day_pct == 100.0 and o.avg_days_between_orders is None
    assert o.lead_time_behavior_proxy == L.CADENCE_CONTINUOUS

    mixed = bi[("S4", "P1")]
    assert seg[("S4", "P1")].inventory_position_segment == L.POSITION_UNDER
    assert mixed.policy_status == L.STATUS_MIXED
    assert mixed.reorder_behavior_assessment == L.TRIGGER_LATE
    assert mixed.impact_theme == L.THEME_SERVICE


def test_rounded_versus_unrounded_rates(spark):
    # 800 of 4001 rows under 1 day of cover: 19.995 % -> rounds to 20.00 %
    rows = [row(d, inv=1, fc=2) for d in range(800)] + [row(d, inv=4, fc=2) for d in range(800, 4001)]
    p = pipeline(spark, rows)
    (pd,) = CATALOG["policy_diagnosis"](p).collect()
    (ra,) = CATALOG["reorder_assessment"](p).collect()
    assert ra.low_cover_pct == 20.0
    assert pd.policy_status == L.STATUS_STABLE          # unrounded 0.19995 < 0.20
    assert ra.reorder_behavior_assessment == L.TRIGGER_LATE  # rounded 20.00 >= 20


def test_abc_borders(spark):
    rows = [row(0, "S1", "P1", sold=80), row(0, "S2", "P1", sold=15), row(0, "S3", "P1", sold=5)]
    seg = one(CATALOG["inventory_segments"](pipeline(spark, rows)))
    assert [seg[(s, "P1")].abc_segment for s in ("S1", "S2", "S3")] == ["A", "B", "C"]
    assert seg[("S1", "P1")].cumulative_units_share == 0.8
    alone = one(CATALOG["inventory_segments"](pipeline(spark, [row(0, sold=9)])))
    assert alone[("S1", "P1")].abc_segment == "C"


def test_duplicates_conflicts_and_invalid_values(spark):
    rows = [
        row(0), row(0),                                                     # same key twice
        row(1, product="P9", category="Y"), row(2, product="P9", category="Y"),
        row(3, product="P9", category="X"), row(4, product="P9", category="X"),  # 2:2 tie -> X
        row(5, price=-1.0, discount=150.0, holiday_promotion=2, inventory_level=None),
    ]
    p = pipeline(spark, rows)
    pm = {r.product_id: r.category_clean for r in CATALOG["product_map"](p).collect()}
    assert pm["P9"] == "X"
    flags = CATALOG["quality_flags"](p).collect()
    assert sorted(r.Duplicate_Flag for r in flags if r.date == D0) == [1, 1]
    assert sum(r.Duplicate_Flag for r in flags) == 2
    y_rows = [r for r in flags if r.product_id == "P9" and r.category == "Y"]
    assert all(r.Category_Mismatch_Flag == 1 for r in y_rows)
    bad = [r for r in flags if r.date == D0 + dt.timedelta(days=5)][0]
    assert (bad.Price_Invalid_Flag, bad.Discount_Invalid_Flag, bad.HolidayPromo_Invalid_Flag,
            bad.Inventory_Invalid_Flag) == (1, 1, 1, 1)
    (audit,) = CATALOG["audit_summary"](p).collect()
    assert audit.duplicate_rows == 1 and audit.missing_values == 1
    assert audit.products_with_multiple_categories == 1


def _reference_cadence(rows):
    """The published formulation, row by row: LAG over order rows by date."""
    by_pair = {}
    for r in rows:
        d = dict(zip(RAW_COLUMNS, r))
        if d["units_ordered"] > 0:
            by_pair.setdefault((d["store_id"], d["product_id"]), []).append((d["date"], d["units_ordered"]))
    out = {}
    for k, ev in by_pair.items():
        ev.sort(key=lambda e: e[0])
        gaps = [(ev[i][0] - ev[i - 1][0]).days for i in range(1, len(ev))]
        sizes = [e[1] for e in ev]
        out[k] = (
            len(ev),
            round(statistics.fmean(sizes), 2),
            round(statistics.stdev(sizes), 2) if len(sizes) > 1 else None,
            round(statistics.fmean(gaps), 2) if gaps else None,
            round(statistics.stdev(gaps), 2) if len(gaps) > 1 else None,
        )
    return out


def test_cadence_with_duplicated_order_days(spark):
    rnd = random.Random(7)
    rows = []
    for s in range(4):
        days = sorted(rnd.sample(range(60), 12))
        for d in days:
            for _ in range(rnd.choice([1, 1, 2, 5])):    # a key repeated up to 5 times
                rows.append(row(d, f"S{s}", "P1", ordered=rnd.randint(1, 30)))
    got = {
        (r.store_id, r.product_id): (
            r.order_event_count, r.avg_order_size_on_order_days, r.order_size_stddev,
            r.avg_days_between_orders, r.stddev_days_between_orders,
        )
        for r in CATALOG["order_cadence"](pipeline(spark, rows)).collect()
    }
    want = _reference_cadence(rows)
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert (a is None and b is None) or math.isclose(a, b, abs_tol=0.0051), (k, got[k], want[k])


@pytest.mark.parametrize("mode,expected", [("zero", 0), ("null", None)])
def test_negative_forecast_modes(spark, mode, expected):
    p = pipeline(spark, [row(0, fc=-3)], negative_forecast=mode)
    (r,) = CATALOG["inventory_clean"](p).collect()
    assert r.demand_forecast_clean == expected


def test_fractional_forecasts_are_kept(spark):
    p = pipeline(spark, [row(0, inv=4, sold=1, fc=-0.4), row(1, inv=4, sold=1, fc=0.5), row(2, inv=3, sold=2, fc=135.47)])
    (audit,) = CATALOG["audit_summary"](p).collect()
    assert audit.negative_forecast_rows == 1 and audit.rejected_cells == 0
    assert [r.demand_forecast for r in CATALOG["negative_forecast_rows"](p).collect()] == [-0.4]
    kb = {r["date"]: r for r in CATALOG["kpi_base"](p).collect()}
    assert kb[D0].demand_forecast_clean == 0 and kb[D0].excess_units_proxy == 4
    half = kb[D0 + dt.timedelta(days=1)]
    assert (half.cover_days, half.high_cover_flag, half.excess_units_proxy, half.forecast_error) == (8.0, 1, 0.5, -0.5)
    (k,) = CATALOG["kpi_overall"](p).collect()
    assert k.total_at_risk_units_proxy == 132.47 and k.total_excess_units_proxy == 4.5


def test_row_keys_are_compared_by_column(spark):
    rows = [row(0, "b|c", "a"), row(0, "c", "a|b"), row(0, None, "P"), row(0, None, "P"), row(0, "P", None)]
    p = pipeline(spark, rows)
    (audit,) = CATALOG["audit_summary"](p).collect()
    assert audit.duplicate_rows == 1
    flags = CATALOG["quality_flags"](p).collect()
    assert len(flags) == 5
    assert sorted((r.store_id or "", r.product_id or "", r.Duplicate_Flag) for r in flags) == [("", "P", 1), ("", "P", 1), ("P", "", 0), ("b|c", "a", 0), ("c", "a|b", 0)]


def test_repeated_keys_follow_an_order_of_the_same_day(spark):
    p = pipeline(spark, [row(0, ordered=3), row(4, ordered=5), row(4, ordered=9), row(4, ordered=9), row(6, ordered=0)])
    day = lambda n: D0 + dt.timedelta(days=n)
    got = sorted((r.order_date, r.units_ordered, r.prev_order_date) for r in CATALOG["order_events"](p).collect() if r.prev_order_date)
    assert got == [(day(4), 5, day(0)), (day(4), 9, day(4)), (day(4), 9, day(4))]
    assert CATALOG["order_events"](p).where("prev_order_date IS NULL").count() == 1
    (c,) = CATALOG["order_cadence"](p).collect()
    assert (c.order_event_count, c.avg_days_between_orders) == (4, round(4 / 3, 2))


def test_cadence_across_blocks(spark):
    rnd = random.Random(3)
    rows = []
    for s in range(3):
        for d in sorted(rnd.sample(range(-200, 500), 40)) + [63, 64, 127, 128]:
            rows.append(row(d, f"S{s}", "P1", ordered=rnd.randint(1, 9)))
    got = {(r.store_id, r.product_id): (r.order_event_count, r.avg_days_between_orders, r.stddev_days_between_orders) for r in CATALOG["order_cadence"](pipeline(spark, rows)).collect()}
    for k, w in _reference_cadence(rows).items():
        assert got[k][0] == w[0] and got[k][1] == pytest.approx(w[3], abs=0.0051) and got[k][2] == pytest.approx(w[4], abs=0.0051)


@pytest.mark.parametrize("parts", [1, 7])
def test_mean_cover_of_exactly_seven_is_not_high(spark, parts):
    # covers of 6.9, 7.1 and thirds: their exact mean is 7, a sum of doubles may miss it by a digit
    rows = [row(d, inv=69, fc=10) for d in range(30)] + [row(d, inv=71, fc=10) for d in range(30, 60)]
    rows += [row(d, inv=20, fc=3) for d in range(60, 75)] + [row(d, inv=22, fc=3) for d in range(75, 90)]
    df = spark.createDataFrame(rows, RAW_SCHEMA).repartition(parts, "date")
    p = InventoryPipeline(df, Thresholds(high_cover_rate=0.9))
    (pd,) = CATALOG["policy_diagnosis"](p).collect()
    assert pd.avg_cover_days == 7.0 and pd.policy_status == L.STATUS_STABLE


def test_excess_follows_the_cover_threshold(spark):
    p = InventoryPipeline(spark.createDataFrame([row(0, inv=50, fc=4)], RAW_SCHEMA), Thresholds(high_cover_days=10.0))
    (k,) = CATALOG["kpi_base"](p).collect()
    assert k.excess_units_proxy == 10 and k.high_cover_flag == 1


def _awkward_days(seed, n):
    """Rows whose keys repeat, miss a store or a day, and lie before 1970 or far apart."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        day = rng.choice([None, D0, D0 + dt.timedelta(days=rng.randint(-70, 140)), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2031, 5, 6)])
        out.append(row(store=rng.choice(["S1", "S2", None]), product=rng.choice(["P1", "P2"]), ordered=rng.choice([0, 3, 8, 8]), date=day))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_by_occupancy(spark, seed):
    rows = _awkward_days(seed, 150)
    p = pipeline(spark, rows)
    key = lambda r: (r[0], r[1], r[2])
    times = {}
    for r in rows:
        times[key(r)] = times.get(key(r), 0) + 1
    assert CATALOG["audit_summary"](p).collect()[0].duplicate_rows == sum(n - 1 for n in times.values())
    flags = CATALOG["quality_flags"](p).collect()
    assert len(flags) == len(rows) and any(r.Duplicate_Flag for r in flags) and not all(r.Duplicate_Flag for r in flags)
    assert all(r.Duplicate_Flag == int(times[r.date, r.store_id, r.product_id] > 1) for r in flags)


@pytest.mark.parametrize("seed", [4, 5])
def test_order_events_equal_lag(spark, seed):
    rows = _awkward_days(seed, 200)
    orders = sorted(((r[1], r[2], r[0], r[7]) for r in rows if r[7] > 0 and r[0] is not None), key=lambda r: (str(r[0]), r[1], r[2], r[3]))
    want, before = [], None
    for r in orders:
        want.append((*r, before[2] if before and before[:2] == r[:2] else None))
        before = r
    want += [(r[1], r[2], None, r[7], None) for r in rows if r[7] > 0 and r[0] is None]
    got = [(r.store_id, r.product_id, r.order_date, r.units_ordered, r.prev_order_date) for r in CATALOG["order_events"](pipeline(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[4] for r in want)


def test_shared_pass_gives_the_same_rollup_and_cadence(spark):
    rows = [r for r in _awkward_days(6, 400) if r[1]]
    alone, shared = pipeline(spark, rows), pipeline(spark, rows)
    shared.pair_blocks.count()
    for name in ("sku_store_summary", "order_metrics", "replenishment_base", "order_cadence", "product_map"):
        a, b = (sorted(map(str, CATALOG[name](p).collect())) for p in (alone, shared))
        assert a == b, name
    assert any("pair_blocks" in w for w in shared._written) and not any("pair_sums" in w for w in shared._written)


def test_labels_that_cleaning_lost_are_reported(spark):
    from shelfwise.operators.quality import clean_label_conflicts

    p = pipeline(spark, [row(0), row(1, category="Other"), row(2, product="P2", category=None)])
    assert {(r.entity, r.entity_id) for r in CATALOG["map_conflicts"](p).collect()} == {("product", "P1")}
    assert CATALOG["clean_label_conflicts"](p).count() == 0
    broken = p.clean.selectExpr("* EXCEPT (category_clean)", "category AS category_clean")
    assert [(r.entity, r.entity_id, r.label_count) for r in clean_label_conflicts(broken).collect()] == [("product", "P1", 2)]


KPI_TABLES = [
    "kpi_overall", "kpi_monthly", "kpi_category", "kpi_region", "kpi_store", "kpi_product",
    "dash_monthly_units", "dash_monthly_wape", "dash_sales_by_category",
]


def kpi_edge_rows():
    rng = random.Random(12)
    rows = [
        row(
            rng.randint(0, 120), rng.choice(["S1", "S2", "S3", None]), rng.choice(["P1", "P2", "P3", "P4", None]),
            inv=rng.choice([0, 3, 70, None]), sold=rng.choice([0, 5, 9, None]), ordered=rng.choice([0, 8]), fc=rng.choice([-2, 0, 4, 6.25, 7.5]),
            category=rng.choice(["Cat", "Cat", "Dog", None]), region=rng.choice(["East", "East", "West", None]),
        )
        for _ in range(600)
    ]
    return [*rows, *rows[:40]]


@pytest.mark.parametrize("rows", [kpi_edge_rows(), []], ids=["edge", "empty"])
def test_kpi_tables_merge_from_one_cube(spark, rows):
    """Each KPI table is the same from the fact and from the written grains, and then reads nothing else."""
    direct, merged = pipeline(spark, rows), pipeline(spark, rows)
    grains = set(merged.kpi_grains.inputFiles())
    for name in KPI_TABLES:
        want, got = CATALOG[name](direct), CATALOG[name](merged)
        assert got.schema.simpleString() == want.schema.simpleString(), name
        assert got.collect() == want.collect(), name
        if name != "dash_sales_by_category":  # reads its own written table
            assert set(got.inputFiles()) <= grains, name
    direct.close()
    merged.close()


def test_the_cube_is_one_scan_of_the_fact(spark):
    from shelfwise.operators import kpi

    p = pipeline(spark, kpi_edge_rows())
    cube = kpi.kpi_cube(p.kpi_base(labels=False))
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_sum(units_sold") == 1
    months = {(r["month"], r["store_id"], r["region"], r["product_id"], r["category"]) for r in cube.collect()}
    assert len(months) == cube.count()
