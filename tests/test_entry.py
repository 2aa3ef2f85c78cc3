"""The driver's entry imports, and names its queries and SQL, before any session and with PySpark from its zip file."""

import os
import subprocess
import sys
from importlib.util import find_spec
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session_from_the_zip():
    lib = Path(find_spec("pyspark").origin).parent / "python" / "lib"
    code = (
        "import pyspark, __spark_entry__ as e; from pyspark import SparkContext\n"
        "assert '.zip' in pyspark.__file__, pyspark.__file__\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert SparkContext._active_spark_context is None and SparkContext._jvm is None\n"
        "assert set(s) <= set(q) and len(s) >= 50, (len(q), len(s))"
    )
    path = ":".join(str(p) for p in [*sorted(lib.glob("*.zip"), reverse=True), ROOT])
    r = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd="/", capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr
