from pyspark.sql import functions as F

from bazarlytics.session import tune


def test_merged_partitions_stay_small(spark):
    """34 MB of hashes in 64 shuffle partitions come to more than one task."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {key: spark.conf.get(key) for key in own}
    tune(spark)
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        rows = spark.range(1_400_000).select("id", *(F.xxhash64("id", F.lit(i)).alias(f"h{i}") for i in range(3)))
        read = [F.bit_xor(f"h{i}") for i in range(3)]
        tasks = rows.repartition("id").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), *read).collect()
        assert len(tasks) >= 3 and sum(r.n for r in tasks) == 1_400_000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
