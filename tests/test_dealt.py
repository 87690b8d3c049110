"""What one task gathers does not grow with the tables."""

from pyspark.sql import functions as F

from chronika.operators import ordered

SF = "/root/testdata/sf0.001"


def test_more_rows_go_to_more_tasks(spark):
    rows = ordered.dealt(spark.range(1000).select((F.col("id") % 200).alias("k")), "k", size=100)
    assert rows.rdd.getNumPartitions() == 10
    assert ordered.dealt(spark.range(10), "id", size=100).rdd.getNumPartitions() == 4
    at = rows.select("k", F.spark_partition_id().alias("at")).distinct()
    assert at.count() == 200 and rows.count() == 1000
