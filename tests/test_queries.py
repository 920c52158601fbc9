"""Every core query beside its SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

from lodestone.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["duplicate_group", "md5", "n_files", "n_splits", "crosses"]


@pytest.mark.parametrize("gone", [["lodestone/llm", "tests/llm"], ["lodestone/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    home = Path(__file__).resolve().parents[1]
    shutil.copytree(home, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".*_cache"))
    for name in gone:
        at = tmp_path / "r" / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; from lodestone.plans.registry import QUERIES, ORACLE_SQL; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
