"""Reports written and read back by request; one request never overwrites another's.

A write is a generation: a folder of as many files as its tasks, sorted by request within each file, in small row groups with a Bloom
filter on the request. Spark commits the folder's files together, so a write that fails leaves nothing to read. The report of
one request is found by its row group alone; of a request that was written again the last generation counts, which is decided without
reading any text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request_id long, report string, generation long"
#: Bytes of a row group.
GROUP = 1 << 20


def _generations(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))


def write_reports(reports: DataFrame, path: str) -> None:
    """reports: request_id, report; one row a request. The same request written again replaces its earlier report only."""
    number = 1 + max(_generations(reports.sparkSession, path), default=0)
    out = reports.select(F.col("request_id").cast("long"), F.col("report").cast("string")).sortWithinPartitions("request_id")
    writer = out.write.mode("errorifexists").option("parquet.block.size", GROUP).option("parquet.bloom.filter.enabled#request_id", True).option("parquet.bloom.filter.adaptive.enabled", True)
    writer.parquet(f"{path.rstrip('/')}/generation={number}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """request_id, report: of every request the last one written."""
    numbers = _generations(spark, path)
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*(f"{path.rstrip('/')}/generation={n}" for n in numbers)) if numbers else spark.createDataFrame([], SCHEMA)
    if len(numbers) > 1:
        rows = rows.join(rows.groupBy("request_id").agg(F.max("generation").alias("generation")), ["request_id", "generation"])
    return rows.select("request_id", "report")


def read_report(spark: SparkSession, path: str, request_id: int) -> DataFrame:
    """The report, or no row; the filter on the request reaches the files of every generation."""
    return read_reports(spark, path).where(F.col("request_id") == int(request_id))
