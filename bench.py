"""Benchmark the headline queries.

every query rebuilds its input from the TPC-H-like parquet tables
(nothing cached between queries), includes planning, and collects its
result to the driver (the fact-size one goes to a sink).  Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.catalog import CATALOG  # noqa: E402
from shelfwise.pipeline import InventoryPipeline  # noqa: E402
from shelfwise.session import local_session  # noqa: E402

HEADLINE = [
    "inventory_raw",
    "kpi_overall",
    "kpi_monthly",
    "kpi_category",
    "kpi_store",
    "inventory_segments",
    "order_cadence",
    "reorder_assessment",
    "business_impact",
    "impact_overall",
]


# a fact-size result goes to a sink: collecting it would time the driver's Python
TO_SINK = {"inventory_raw"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    spark = local_session(cpus, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-ckpt-"))

    # Session start-up (JVM/JIT, first Parquet write and read) is not query
    # time: touch each code path once on a few generated rows, no test data.
    warm = tempfile.mkdtemp(prefix="bench-warmup-")
    spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS s").write.parquet(f"{warm}/w")
    spark.read.parquet(f"{warm}/w").groupBy("s").count().collect()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        # leaving the block removes the stages this query wrote
        with InventoryPipeline.from_tpch(spark, sf_dir) as p:
            df = CATALOG[name](p)
            if name in TO_SINK:
                df.write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - t0, 3)
                rows[name] = df.count()
            else:
                rows[name] = len(df.collect())
                times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "session_warmup": True,
                "cold_per_query": True,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
