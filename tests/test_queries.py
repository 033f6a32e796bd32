import sys
from pathlib import Path

import pytest

from tests.compare import duck, rows

sys.path.insert(0, str(Path(__file__).parent.parent))
from strandline.plans.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
