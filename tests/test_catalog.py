from __spark_entry__ import entry, oracle_sql, queries


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and "total_tokens" in df.columns
