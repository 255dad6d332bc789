from lakeweave.plans import patterns


def test_rates_are_looked_up_without_a_join(spark, tiny):
    for name in ("shipments", "ledger", "orders", "events"):
        if name in patterns.DOMAINS:
            plan = patterns.QUERIES[f"rate_normalization_{name}"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan


def test_rates_of_rows_without_a_category(spark, tmp_path):
    spark.sql("SELECT 1L AS l_orderkey, 1L AS l_linenumber, 2L AS l_suppkey, CAST(10 AS DOUBLE) AS l_extendedprice, timestamp'1995-01-01' AS l_shipdate, CAST(NULL AS STRING) AS l_returnflag, 'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.normalized for r in patterns.QUERIES["rate_normalization_ledger"](spark, str(tmp_path)).collect()] == [9.5]
