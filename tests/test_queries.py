"""Every named query against its SQL, and the entry points with and without the training-text operators."""

import subprocess
import sys

import pytest
from oracle import assert_equal, tables

from vantage import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, base, name):
    assert_equal(spark, base, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_text_operators():
    code = "import sys; sys.modules['vantage.llm'] = None; sys.modules.pop('vantage.llm.queries', None)\nimport __spark_entry__ as e\nassert 'flagship' in e.queries() and not any(x.startswith('op') for x in e.queries())"
    blocked = "import sys\nclass Gone:\n def find_spec(self, name, path=None, target=None):\n  if name.startswith('vantage.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\n" + code.split("\n", 1)[1]
    subprocess.run([sys.executable, "-c", blocked], check=True, timeout=100)
