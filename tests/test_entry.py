"""The driver's contract, with and without the optional subpackage."""

import pathlib
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_query(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and {"Pct_NS", "Pct_EW"} <= set(df.columns)


def test_library_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tricklake", tmp_path / "tricklake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') or k == 'pipeline' for k in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
