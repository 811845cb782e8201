"""Every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from __spark_entry__ import entry
from check_oracle import check, connect
from filescape.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.ORACLE)


def test_entry(spark, connection):
    expected = connection.sql(oracle.ORACLE["duplicate_groups"])
    found = entry(spark).select(*expected.columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


@pytest.mark.parametrize("left_over", [True, False])
def test_entry_without_the_training_operators(tmp_path, left_over):
    """The core queries stay when the subpackage goes, whether or not an empty folder is left."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(f"{home}/filescape", copy / "filescape", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", copy)
    if left_over:
        (copy / "filescape" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split() == [str(len(registry.QUERIES))] * 2, done.stderr


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, connection, name):
    problem, rows, _ = check(spark, connection, SF_DIR, name)
    assert not problem
    assert rows > 0
