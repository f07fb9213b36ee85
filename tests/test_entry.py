"""Registered queries: every name has a callable, and SQL is given for known names only."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_names():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_core_stands_alone(tmp_path):
    """Without the corpus folders the entry still imports and lists the other queries."""
    for name in ("__spark_entry__.py", "tracekiln"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "tracekiln"
    package.mkdir()
    for child in (ROOT / "tracekiln").iterdir():
        if child.name not in ("llm", "__pycache__"):
            (package / child.name).symlink_to(child)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rex_scores' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=False)
    assert done.returncode == 0, done.stderr
