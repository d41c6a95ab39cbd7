"""Parts of a review batch that comes as one file."""

from pyspark.sql import functions as F
from small_tables import SF_SMALL

from trustlens.operators.partitioning import dealt, spread
from trustlens.plans import catalog


def test_parts_of_one_file_are_cut_by_bytes(spark, tmp_path):
    """Ten times the rows do not make ten times larger parts."""
    keys = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        most = []
        for n in (3000, 30_000):
            path = f"{tmp_path}/{n}"
            spark.range(n).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
            parts = spread(spark.read.parquet(path)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("text").alias("n"), F.sum("doc_id").alias("s"))
            rows = parts.collect()
            assert sum(r["n"] for r in rows) == n and sum(r["s"] for r in rows) == n * (n - 1) // 2
            most.append(max(r["n"] for r in rows))
        assert most[1] < 4 * most[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_dealt_batch_is_written_once_with_its_rows(spark, tmp_path):
    """Rows, nulls included, and files for all cores; a table of enough files stays where it is."""
    path, cores = f"{tmp_path}/one", spark.sparkContext.defaultParallelism
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("if(id % 7 = 0, null, cast(id as string))").alias("text"))
    docs.coalesce(1).write.parquet(path)
    out = dealt(spark.read.parquet(path))
    assert sorted(out.collect()) == sorted(docs.collect()) and len(out.inputFiles()) >= cores
    assert dealt(out) is out and dealt(spark.read.parquet(path).filter("doc_id < 0")).count() == 0


def test_no_branch_of_a_scored_batch_deals_the_texts_again(spark):
    """From one file, each of its branches had an exchange of all texts."""
    plan = catalog.q_scored_batch(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "REBALANCE" not in plan.upper()
