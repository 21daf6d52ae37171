import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rel_path", "total", "uniques"] and df.count() > 0


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 45 and set(oracle) <= set(queries)
