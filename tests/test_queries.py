"""Every query with SQL gives the rows of its SQL; the others give rows."""

import os
import pathlib
import shutil
import subprocess
import sys

import oracle
import pytest

from stridewell.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, sf, con, name):
    assert oracle.differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_llm(tmp_path):
    """On a copy that lacks the subpackage, its tests and the pipeline, in a process of its own."""
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "*.txt"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), "False", "True"], said.stderr
