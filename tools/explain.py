"""Print the physical plan of registered queries.

usage: python tools/explain.py [sf_dir] query [query ...]

Runs each query once (so AQE shows its final plan) and prints
``explain("formatted")`` followed by a one-line digest: exchanges,
join strategies, window and single-partition nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.catalog import CATALOG  # noqa: E402
from shelfwise.pipeline import InventoryPipeline  # noqa: E402
from shelfwise.session import local_session  # noqa: E402


def digest(plan: str) -> str:
    # an adaptive plan prints its final plan, then the initial one: count the final
    plan = plan.split("== Initial Plan ==")[0]
    count = lambda pat: len(re.findall(pat, plan))
    return (
        f"exchanges={count(r'Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin')} "
        f"single_partition={count(r'SinglePartition')} "
        f"broadcast_joins={count(r'BroadcastHashJoin')} sort_merge_joins={count(r'SortMergeJoin')} "
        f"windows={count(r'Window \[')}"
    )


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in args or ["business_impact"]:
        df = CATALOG[name](InventoryPipeline.from_tpch(spark, sf))
        df.collect()
        print(f"===== {name} =====")
        df.explain("formatted")
        print("digest:", digest(df._jdf.queryExecution().executedPlan().toString()))


if __name__ == "__main__":
    main()
