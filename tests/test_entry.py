import __spark_entry__


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["host", "links", "targets"] and out.count() > 0


def test_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert all(map(callable, names.values()))
