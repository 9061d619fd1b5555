"""Sources dealt to tasks by bytes, and sources that can't be scanned."""

from pyspark.sql import functions as F

from codefacts import extract


def test_no_task_has_more_than_its_share(spark):
    """One text of 50 MB, 40 of 1 MB and 4000 short ones that lie in one input partition."""
    rows = spark.range(4041).repartition(1).select(
        F.col("id").alias("file_id"), F.lit(1).alias("codebase_id"),
        F.repeat(F.lit("x"), F.when(F.col("id") == 7, 50_000_000).when(F.col("id") % 101 == 0, 1_000_000).otherwise(F.col("id").cast("int") % 3000)).alias("content"))
    task = 4 << 20
    dealt = extract.balanced(rows, task).select("file_id", F.octet_length("content").alias("n"), F.spark_partition_id().alias("p")).toPandas()
    assert sorted(dealt["file_id"]) == list(range(4041))
    loads = dealt.groupby("p")["n"].sum()
    alone = dealt[dealt["file_id"] == 7]["p"].iloc[0]
    assert (dealt["p"] == alone).sum() == 1
    rest = loads.drop(alone)
    assert rest.max() <= 2 * rest.median() and rest.max() <= 2 * task and len(rest) >= 10


def test_balance_of_no_texts_and_null_texts(spark):
    schema = "file_id long, codebase_id long, content string"
    assert extract.balanced(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in extract.balanced(spark.createDataFrame([(5, 1, None)], schema)).collect()] == [(5, 1, None)]


def test_sources_that_fail_are_counted(spark):
    rows = spark.createDataFrame([(1, 1, "class AOne {};"), (2, 2, None)], "file_id long, codebase_id long, content string")
    scanned = extract.scan_sources(rows)
    assert extract.scan_failures(scanned).collect() == []
    lost = scanned.withColumn("failed", F.when(F.col("file_id") == 2, "RecursionError"))
    assert [tuple(r) for r in extract.scan_failures(lost).collect()] == [(2, "RecursionError", 1)]
