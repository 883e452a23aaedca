import os

import pytest

import __spark_entry__ as contract
from tributary.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"parse_text_lines", "template_documents"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_flagship(spark):
    out = contract.entry(spark)
    assert out.columns == ["event_type", "n", "p95_value"] and out.count() > 0
