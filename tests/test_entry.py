import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registered_queries_have_their_parts():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.where("NOT ok").count() == 0
