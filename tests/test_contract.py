"""What the driver relies on before any session exists."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 150; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
