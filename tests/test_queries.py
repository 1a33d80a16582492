"""Every query with an equivalent in SQL gives the same rows."""

import comparing
import pytest

from citadine.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Slow for what they tell at the smallest scale; compared at a larger one by the driver.
ELSEWHERE = {"density_floor", "local_maxima", "seed_movement", "evaluation_rollup"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - ELSEWHERE))
def test_same_rows(spark, sf, name):
    assert comparing.difference(QUERIES[name](spark, sf), sf, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
