"""The driver contract, also without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["exact_pairs"] >= row[0]["cross_split_pairs"] > 0


def test_imports_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "tessera"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
