from __future__ import annotations

import pytest
from tables import same_rows

from quillbin.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck.sql(ORACLES[name]))


def test_entry_has_the_binning_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["performance", "precision", "sensitivity", "assigned"]
