"""Every query with an oracle gives the oracle's rows."""

import pytest

from quern.plans import catalogue
from tests.compare import agree
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    agree(catalogue.queries()[name](spark, DATA), duck, catalogue.oracle_sql()[name])


def test_every_query_has_rows_or_an_oracle(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert not catalogue.queries()[name](spark, DATA).isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
