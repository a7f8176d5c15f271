import pytest

from compare import same
from rigtables.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(name, spark, duck, sf_dir):
    got, want = same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
