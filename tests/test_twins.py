"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_twins import differences
from helpers import SMALL

from tickloom.plans import load_all

QUERIES, TWINS = load_all()
SLOW = {"compare_specs", "fit_flattened_targets"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert differences(got, duck.execute(TWINS[name]).df()) == ""


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
    assert len(QUERIES) - len(TWINS) <= 4


def test_flattened_and_compared_fits(spark):
    flat = QUERIES["fit_flattened_targets"](spark, SMALL).toPandas()
    assert sorted(flat.responder_num) == list(range(9)) and (flat.loss > 0).all()
    specs = QUERIES["compare_specs"](spark, SMALL).toPandas()
    assert list(specs.spec) == ["v02", "v06", "v12", "v13"] and specs.loss.notna().all()


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 83 and df.columns == ["date_id", "loss", "n"]
