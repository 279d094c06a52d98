import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    flagship = __spark_entry__.entry(spark)
    assert flagship.count() > 0 and flagship.columns == ["plan", "images", "total"]
