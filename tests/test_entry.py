"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "point_id", "dist"] and df.count() > 0


def test_nothing_else_imports_the_subpackage(tmp_path):
    for path in (ROOT / "lodestar").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lodestar.llm" not in path.read_text(), path
    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "lodestar/llm/__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; assert 'knn_l2' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_an_import_that_the_subpackage_lacks(tmp_path):
    """Without one of its libraries the other queries remain."""
    if not (ROOT / "lodestar/llm").is_dir():
        pytest.skip("no subpackage")
    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here', name='xxhash')")
    code = "import __spark_entry__ as e; assert 'knn_l2' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
