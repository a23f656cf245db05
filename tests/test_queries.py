import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, small, name):
    assert compare(spark, con, small, QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert "overall_confidence" in entry.entry(spark).columns


def test_without_the_optional_part(tmp_path):
    """The other queries stand without the training-data subpackage and its pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    many, sqls, optional = done.stdout.split()
    assert many == sqls and int(many) > 40 and optional == "False"
