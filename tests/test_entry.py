import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["order_number", "line_count", "total_price"]
    assert df.count() > 0
