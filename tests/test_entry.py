import __spark_entry__ as driver


def test_entry_and_names(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_some_queries(spark, sf):
    for name in ("ch", "xb_lineitem", "ari_orders", "ami_labels", "mst_edges", "grid_cells", "score_report", "external_sweep"):
        assert driver.queries()[name](spark, sf).count() > 0, name
