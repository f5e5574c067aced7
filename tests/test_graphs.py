from workloads import graphs


def test_rows_are_spread_before_they_become_triples(spark, tmp_path):
    spark.range(40).selectExpr("id AS r_regionkey", "'r' || id AS r_name", "'unused' AS r_note").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    spec = [("region", graphs.uri("x/", graphs.num("r_regionkey")), [("<x#name>", graphs.text("r_name")), ("<x#key>", graphs.text(graphs.num("r_regionkey")))])]
    found = graphs.build(spark, str(tmp_path), spec)
    assert found.count() == 80
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
