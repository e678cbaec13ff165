import duckdb
import pytest
from sparkveil.plans import catalogue, desk_catalogue, review_catalogue  # noqa: F401
from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_its_oracles_rows(spark, con, name):
    oracle.same(catalogue.QUERIES[name](spark, SMALL), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_every_aligned_value_is_where_it_says(spark):
    rows = catalogue.QUERIES["align_gold"](spark, SMALL).collect()
    assert rows and all(r["defect"] == (", " in r["value"]) for r in rows) and all(r["end"] - r["start"] == len(r["value"]) for r in rows if not r["defect"])


def keyed(spark, path, *keys):
    """Customers of these keys, and what SQL reads them by."""
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").coalesce(1).write.parquet(f"{path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/customer.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["dissected_leaks", "pending_leaks", "stream_leaks"])
def test_leaks_of_keys_that_stand_in_other_numbers(spark, tmp_path, name):
    con = keyed(spark, tmp_path, 7, 13830, 19000, 31373, 37625, 50325, 61989)
    oracle.same(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.ORACLES[name])
