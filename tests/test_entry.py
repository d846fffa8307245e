"""Driver contract: the flagship query runs, every oracle key is a query key."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"input", "rank", "match", "score"}
    assert df.count() >= 0


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
