"""The first pair rollup of a brand-new session must plan (regression test).

Joining two branches of one unwritten multi-join source plan in one query
once tripped Spark's relation de-duplication on a session's first try;
the pipeline gives the second branch its own instance of the source.
"""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_first_rollup_in_new_session(sf_small):
    code = textwrap.dedent(
        f"""
        import sys, tempfile
        sys.path.insert(0, {REPO!r})
        from shelfwise.session import local_session
        from shelfwise.catalog import CATALOG
        from shelfwise.pipeline import InventoryPipeline
        s = local_session(2, **{{"spark.ui.showConsoleProgress": "false"}})
        s.sparkContext.setLogLevel("ERROR")
        if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
            s.sparkContext.setCheckpointDir(tempfile.mkdtemp())
        p = InventoryPipeline.from_tpch(s, {sf_small!r})
        print("ROWS", len(CATALOG["sku_store_summary"](p).collect()))
        print("CAT", len(CATALOG["kpi_category"](InventoryPipeline.from_tpch(s, {sf_small!r})).collect()))
        """
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "ROWS 250" in out.stdout, out.stderr[-2000:]
    assert "CAT " in out.stdout, out.stderr[-2000:]
