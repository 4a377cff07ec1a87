"""Every query of the engine against its SQL."""

import pytest
from compare import same_rows
from conftest import SF

import __spark_entry__ as driver
from windrow import plans, registry

plans.load()
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    same_rows(registry.queries()[name](spark, SF), duck, ORACLES[name])


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["word", "n"] and df.count() > 0


def test_names_agree():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(registry.queries()) == set(ORACLES)


def test_registering_twice_is_an_error():
    with pytest.raises(ValueError):
        registry.query("word_count")(lambda s, d: None)
