"""The entry has to be readable before there is a Spark session."""

import os
import subprocess
import sys


def test_names_and_sql_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
