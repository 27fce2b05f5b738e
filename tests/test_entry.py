import os
import subprocess
import sys

from conftest import ROOT


def test_queries_are_listed_without_a_session():
    """The registry is read before any session exists."""
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=120)
