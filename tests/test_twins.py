import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from shardloom.plans import catalogue
from twins import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_twin(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    assert not differences(got, duck.sql(catalogue.oracles()[name]).df())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
