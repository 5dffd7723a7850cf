import __spark_entry__ as entry


def test_flagship_query(spark):
    got = entry.entry(spark)
    assert got.columns == ["similarity_threshold", "n_pairs", "n_cliffs", "cliff_fraction"] and got.count() == 21


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
