"""The driver's entry points, with and without the package for training text."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_package(tmp_path):
    for name in ("__spark_entry__.py", "foliant"):
        (tmp_path / name).symlink_to(ROOT / name)
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (bare / "foliant").mkdir()
    (bare / "foliant" / "__init__.py").write_text("")
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=bare, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(bare)}, capture_output=True, text=True)
    assert "corpus_sources" in done.stdout and "op1" not in done.stdout, done.stderr


def test_nothing_else_imports_the_package():
    for path in (ROOT / "foliant").rglob("*.py"):
        if "llm" not in path.parts:
            assert "foliant.llm" not in path.read_text() and "from .llm" not in path.read_text()


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None, reason="needs duckdb")
def test_sources_equal_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["corpus_sources"]).fetchall())
    assert sorted(map(tuple, entry.queries()["corpus_sources"](spark, data).collect())) == want
