"""Every query that has SQL gives the rows of its SQL; the others run and keep their schema."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark.plans import catalogue
from tests.comparing import assert_same, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, sf_dir, name):
    columns, rows = sql_rows(catalogue.ORACLES[name], sf_dir)
    assert_same(catalogue.QUERIES[name](spark, sf_dir), columns, rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_and_contract():
    import __spark_entry__ as e

    assert catalogue.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_folders(tmp_path):
    """The library alone still lists and states its queries."""
    root = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    program = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k[:2] == 'op' for k in e.queries()))"
    told = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert told.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"]
