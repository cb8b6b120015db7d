"""Reports as files: one generation a write, one file a task, one row group a report."""

import pytest
from pyspark.sql import functions as F

from releaselode.sources import sinks

from test_landed import rows_read


def made(spark, ids, text):
    return spark.createDataFrame([(i,) for i in ids], "request_id int").select("request_id", F.concat(F.lit(text), F.col("request_id").cast("string")).alias("report"), F.lit("x").alias("status"))


def test_the_last_write_of_a_request_counts(spark, tmp_path):
    path = str(tmp_path / "r")
    assert sinks.read_reports(spark, path).count() == 0
    sinks.write_reports(made(spark, range(20), "first "), path)
    sinks.write_reports(made(spark, [3, 50], "second "), path)
    sinks.write_reports(made(spark, [3], "third "), path)
    sinks.write_reports(made(spark, [], "none "), path)
    got = {r.request_id: r.report for r in sinks.read_reports(spark, path).collect()}
    assert got == {i: f"first {i}" for i in range(20)} | {50: "second 50", 3: "third 3"}
    one = lambda i: [tuple(r) for r in sinks.read_report(spark, path, i).collect()]
    assert (one(3), one(4), one(99)) == ([(3, "third 3")], [(4, "first 4")], [])


def test_as_many_files_as_tasks_and_one_row_group_read(spark, tmp_path):
    path = str(tmp_path / "r")
    big = spark.range(40_000).repartition(5, F.col("id")).select(F.col("id").alias("request_id"), F.concat_ws(" ", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(8))).alias("report"))
    sinks.write_reports(big, path)
    assert len(list((tmp_path / "r" / "generation=1").glob("*.parquet"))) == 5
    some = sinks.read_report(spark, path, 12_345)
    assert rows_read(some) < 8_000 and len(some.first().report) == 8 * 65 - 1


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_reports(made(spark, range(4), "first "), path)
    broken = made(spark, range(4), "second ").withColumn("report", F.when(F.col("request_id") == 3, F.raise_error("stop")).otherwise(F.col("report")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_reports(broken, path)
    assert {r.report for r in sinks.read_reports(spark, path).collect()} == {f"first {i}" for i in range(4)}
    sinks.write_reports(made(spark, [1], "third "), path)
    assert sinks.read_report(spark, path, 1).first().report == "third 1"
