import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 121
    first = entry.entry(spark)
    assert first.count() > 0 and first.columns == queries["q01_split_statistics"](spark, entry.SMOKE_DIR).columns
