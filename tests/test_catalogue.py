import pytest

from strophe import catalogue
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_flagship_has_rows(spark):
    assert catalogue.flagship(spark, SF).count() > 0
