import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["status"] for r in rows} >= {"SUCCEEDED", "FAILED"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
