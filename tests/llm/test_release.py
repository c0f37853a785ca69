"""What is done with is let go whenever a table is settled, without waiting for the driver's next collection."""

import time

from pyspark.sql import functions as F

from millrace.llm.frames import release, settle


def held(spark):
    """How many shuffles the driver keeps."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_settled_table_lets_earlier_shuffles_go(spark):
    for _ in range(2):
        release(spark)
        time.sleep(1)
    before = held(spark)
    for n in range(5):
        spark.range(1000).repartition(7 + n).groupBy((F.col("id") % 10).alias("k")).count().collect()
    assert held(spark) > before
    for _ in range(2):
        rows = settle(spark.range(3))
    for _ in range(50):
        if held(spark) <= before:
            break
        time.sleep(0.1)
    assert held(spark) <= before and rows.count() == 3
