"""The driver reads the query names in a process without a session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split())
    assert n >= m > 60
