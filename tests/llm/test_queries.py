import pytest
from sparkveil.llm import queries
from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_its_oracles_rows(spark, name):
    oracle.same(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLES[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
