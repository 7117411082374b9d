"""The training-data operators are optional: everything else works without their folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_operators(tmp_path):
    shutil.copytree(f"{REPO}/shelfwise", tmp_path / "shelfwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 91 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) == set(q); print('FINE')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "FINE" in out.stdout, out.stderr[-2000:]


def test_nothing_else_imports_them():
    for top in ("shelfwise", "tools"):
        for folder, _, names in os.walk(os.path.join(REPO, top)):
            if os.sep + "llm" in folder:
                continue
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "shelfwise.llm" not in f.read(), os.path.join(folder, n)
