"""Every registered query of the table operators against its SQL."""

import pytest

from tabulon.plans import catalogue

from .compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        same(df, SF, catalogue.ORACLE[name])
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 200
