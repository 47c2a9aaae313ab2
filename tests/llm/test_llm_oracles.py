import pytest

from casewell.llm.queries import ORACLES, QUERIES
from tests.oracle import connection, difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert difference(spark, sf, QUERIES[name], ORACLES[name], connection(sf)) is None


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
